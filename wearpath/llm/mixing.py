"""Mix sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Each source has a share of the mix. `targets` turns shares into word budgets: the total is dealt by
weight, a source stops at ``most_epochs`` times its own size, and the excess is dealt again by weight
until no source is above its stop. This has a closed form: with sources ordered by
``stop / weight`` the first ones are at their stop and all others share the rest.

`mix` takes every document ``floor(target / size)`` times (complete epochs come first); what is left
of the budget goes to one more, partial epoch. Each document draws a key ``-ln(u) / quality``, where
``u`` is a hash of its id, so that reruns agree. Documents of a source are taken in ascending key until
the budget is used; the last one is taken in part, so a source meets its target to the word.

Scale: a source may hold any share of the rows. Keys are cut into ranges (about the square root of the
source's document count each); range sums give each range the sum before it, and only the rows of one
range are ordered together. Everything is DataFrame functions.

Defined cases: null text has size 0 and is taken 0 times; a null source is a source of its own, last in
order; rows repeated in full are taken one after the other; a null quality counts as the lowest; empty
input gives an empty result; other columns pass through, and working columns start with ``__mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOWEST_QUALITY = 0.1
#: Characters that junk is full of; their share lowers the quality of a text.
JUNK = "#*$%&|<>!"


def uniform(*parts: Column) -> Column:
    """A number above 0 and below 1 from 48 bits of an MD5 digest."""
    digest = F.substring(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts])), 1, 12)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def text_quality(text: Column) -> Column:
    """1 for text without junk characters, down to 0.1 as their share goes to one in ten."""
    n = F.length(text)
    junk = n - F.length(F.translate(text, JUNK, ""))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(LOWEST_QUALITY), 1 - 10.0 * junk / n))


def targets(sizes: DataFrame, source: str, size: str, weight: str, total_share: float, most_epochs: float) -> DataFrame:
    """(source, size, weight) per source -> the same with ``target``. One row a source: a small table."""
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("__ratio"), F.col(source).asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    stop = F.lit(float(most_epochs)) * F.col(size)
    ranked = (
        sizes.withColumn("__ratio", stop / F.col(weight))
        .withColumn("__total", F.lit(float(total_share)) * F.sum(size).over(everything))
        .withColumn("__weights", F.sum(weight).over(everything))
        .withColumn("__stopped", F.coalesce(F.sum(stop).over(before), F.lit(0.0)))
        .withColumn("__gone", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    )
    # The level each source would see if all before it are at their stop; the first that is not at its stop sets the level.
    level = (F.col("__total") - F.col("__stopped")) / (F.col("__weights") - F.col("__gone"))
    open_level = F.min(F.when(F.col("__ratio") > F.col("__level"), F.struct("__ratio", "__level"))).over(everything)["__level"]
    return (
        ranked.withColumn("__level", level)
        .withColumn("__open", open_level)
        .withColumn("target", F.least(stop, F.coalesce(F.col("__open") * F.col(weight), stop)))
        .select(source, size, weight, "target")
    )


def mix(docs: DataFrame, source: str, doc_id: str, size: Column, quality: Column, weights: Sequence[int] = (5, 2, 1),
        total_share: float = 1.5, most_epochs: float = 2.0, seed: int = 8, least_rows: int = 256) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target`` and ``taken`` (units of size taken, repeats counted) to every row.

    Sources in code point order, null last, weigh ``weights`` in turn. ``least_rows``: rows that are ordered together at least.
    """
    keyed = docs.withColumns({"__mix_size": size.cast("long"), "__mix_quality": F.greatest(F.lit(LOWEST_QUALITY), F.coalesce(quality, F.lit(LOWEST_QUALITY)))})
    keyed = keyed.withColumn("__mix_key", -F.log(uniform(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("none")))) / F.col("__mix_quality"))
    sizes = keyed.groupBy(F.col(source).alias("__mix_source")).agg(F.sum("__mix_size").alias("__mix_of"), F.count(F.lit(1)).alias("__mix_rows"))
    order = Window.orderBy(F.col("__mix_source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    plan = targets(sizes.withColumn("__mix_weight", turn), "__mix_source", "__mix_of", "__mix_weight", total_share, most_epochs)
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("__mix_of") > 0, F.floor(budget / F.col("__mix_of"))).otherwise(0)
    plan = (
        plan.join(sizes.select("__mix_source", "__mix_rows").withColumnRenamed("__mix_source", "__s"), F.col("__mix_source").eqNullSafe(F.col("__s"))).drop("__s")
        .withColumn("__mix_epochs", epochs.cast("long"))
        .withColumn("__mix_left", (budget - F.col("__mix_epochs") * F.col("__mix_of")).cast("long"))
        .withColumn("__mix_ranges", F.ceil(F.col("__mix_rows") / F.greatest(F.lit(float(least_rows)), F.sqrt("__mix_rows"))).cast("long"))
    )
    rows = keyed.join(plan, F.col(source).eqNullSafe(F.col("__mix_source")))
    # exp(-lowest quality * key) falls from 1 to 0 and no stretch of it holds many times its share of the keys.
    place = F.floor((1 - F.exp(-F.lit(LOWEST_QUALITY) * F.col("__mix_key"))) * F.col("__mix_ranges")).cast("long")
    rows = rows.withColumn("__mix_range", place)
    by_range = rows.groupBy("__mix_source", "__mix_range").agg(F.sum("__mix_size").alias("__mix_in"))
    earlier = Window.partitionBy("__mix_source").orderBy("__mix_range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = by_range.select(F.col("__mix_source").alias("__s"), F.col("__mix_range").alias("__r"),
                               F.coalesce(F.sum("__mix_in").over(earlier), F.lit(0)).alias("__mix_before"))
    rows = rows.join(by_range, F.col("__mix_source").eqNullSafe(F.col("__s")) & (F.col("__mix_range") == F.col("__r")))
    inside = Window.partitionBy("__mix_source", "__mix_range").orderBy("__mix_key", doc_id, "__mix_size")
    start = F.col("__mix_before") + F.sum("__mix_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__mix_size")
    part = F.greatest(F.lit(0), F.least(F.col("__mix_size"), F.col("__mix_left") - start))
    return rows.select(
        *[F.col(c) for c in docs.columns if c not in ("size", "source_size", "target", "taken")],
        F.col("__mix_size").alias("size"), F.col("__mix_of").alias("source_size"), F.col("target"),
        (F.col("__mix_epochs") * F.col("__mix_size") + part).cast("long").alias("taken"),
    )
