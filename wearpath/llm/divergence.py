"""How far the sources of a language differ in their words, priced from joint tables of counts.

1. *Cells.* Tasks cut texts into terms, encode them exactly and count each (language, source, term) with its documents;
   partial counts meet by key. Each language keeps the terms in enough of its documents.
2. *Levels.* A group's price of a term depends on the term's count alone, so a group's terms fall into count levels. For
   a block of terms, one 0/1 column for each (group, level) makes an indicator matrix; its transpose times itself holds
   every joint table: how many terms have level a in one group and level b in another. Products are exact, as no entry
   exceeds the block's terms. A joint table times the differences of prices is that pair's share of the divergence.
3. *Blocks.* Terms are dealt into blocks by a hash, groups into blocks of ``GROUPS`` by their order; a task holds one
   block of terms for one pair of blocks of groups. Terms are sorted by their total first and cut so that a product has
   about ``COLUMNS`` columns. Terms that none of a cell's groups has differ by the prices of zero, which are added at the end.

Prices are integers, 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), computed in decimals: all results are exact
while a pair's sum stays within a long.

Defined cases: null texts, languages and sources are empty strings; empty texts make a group without terms, whose prices
are those of zero; a language without kept terms has differences of 0 and no term rows; rows that repeat, and rows that
share an id, are documents of their own, as ids are not read; other columns are not read; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .batches import LOWERED, bytes_of, ranges

LEAST_DOCUMENTS, SMOOTH, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
TERMS, GROUPS, COLUMNS = 16_384, 64, 1024
#: Bytes of text counted at once; one longer text is counted whole.
PIECE = 1 << 22
#: Letters: A-Z, a-z and every byte of a character outside ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[ord("A"):ord("Z") + 1] = LETTER[ord("a"):ord("z") + 1] = LETTER[128:] = True


def terms_of(column: pa.Array):
    """(terms, row of each) of a string column."""
    data, offsets = bytes_of(column)
    inside = LETTER[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    letters = np.r_[0, np.cumsum(inside)]
    places = np.r_[letters[starts], letters[-1]].astype(np.int64)
    packed = LOWERED[data[inside]]
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.tobytes()), pa.py_buffer(packed.tobytes()))
    return terms, np.searchsorted(offsets, starts, side="right") - 1


def cells(docs: DataFrame) -> DataFrame:
    """(lang, source, text) -> lang, source, term, count, docs: the term's occurrences and documents in the group."""
    def run(batches):
        for batch in batches:
            _, offsets = bytes_of(batch.column(2))
            for lo, hi in ranges(offsets, PIECE):
                part = batch.slice(lo, hi - lo)
                terms, rows = terms_of(part.column(2))
                if not len(terms):
                    continue
                coded = terms.dictionary_encode()
                langs, sources = (part.column(i).dictionary_encode() for i in (0, 1))
                group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
                size = len(coded.dictionary)
                in_row, times = np.unique(rows * size + coded.indices.to_numpy(), return_counts=True)
                key, at = np.unique(group[in_row // size] * size + in_row % size, return_inverse=True)
                groups = key // size
                yield pa.RecordBatch.from_arrays([
                    langs.dictionary.take(pa.array(groups // len(sources.dictionary))), sources.dictionary.take(pa.array(groups % len(sources.dictionary))),
                    coded.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(np.bincount(at, times, len(key)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(key)))],
                    ["lang", "source", "term", "count", "docs"])

    found = docs.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def price(count: str, total: str, terms: str):
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), without rounding."""
    return F.expr(f"1L + (CAST({SCALE} AS DECIMAL(10, 0)) * ({count} + {SMOOTH})) div ({total} + {SMOOTH} * {terms})")


def pair_sums(cell: pd.DataFrame, cross: bool, per_block: int = GROUPS, columns: int = COLUMNS) -> pd.DataFrame:
    """Sums of price differences over the terms of a cell, for each pair of its groups.

    ``cell``: g (group), term (null: the group itself, with its price of zero), count, p. With ``cross`` only pairs
    of one group of the lower and one of the upper block.
    """
    groups = cell[cell["term"].isna()].sort_values("g")
    g, zero = groups["g"].to_numpy(), groups["p"].to_numpy()
    rows = cell[cell["term"].notna()]
    code, terms = pd.factorize(rows["term"])
    count = np.zeros((len(terms), len(g)), dtype=np.int64)
    at = np.searchsorted(g, rows["g"].to_numpy())
    count[code, at] = rows["count"].to_numpy()
    prices = np.broadcast_to(zero, count.shape).copy()
    prices[code, at] = rows["p"].to_numpy()
    order = np.argsort(count.sum(axis=1), kind="stable")
    count, prices = count[order], prices[order]
    sums = np.zeros((len(g), len(g)), dtype=np.int64)
    first, step = 0, 4096
    while first < len(terms):
        block = count[first:first + step]
        levels = [np.unique(block[:, i], return_index=True, return_inverse=True) for i in range(len(g))]
        if sum(len(x[0]) for x in levels) > columns and step > 32:
            step //= 2
            continue
        bounds = np.cumsum([0] + [len(x[0]) for x in levels])
        indicator = np.zeros((len(block), bounds[-1]), dtype=np.float32)  # products stay below 2^24, so they are exact
        cost = np.empty(bounds[-1], dtype=np.int64)
        for i, (_, index, inverse) in enumerate(levels):
            indicator[np.arange(len(block)), bounds[i] + inverse] = 1
            cost[bounds[i]:bounds[i + 1]] = prices[first + index, i]
        joint = (indicator.T @ indicator).astype(np.int64)
        joint *= np.abs(cost[:, None] - cost[None, :])
        sums += np.add.reduceat(np.add.reduceat(joint, bounds[:-1], axis=0), bounds[:-1], axis=1)
        first += step
    a, b = np.triu_indices(len(g), 1)
    if cross:
        apart = g[a] // per_block != g[b] // per_block
        a, b = a[apart], b[apart]
    return pd.DataFrame({"a": g[a], "b": g[b], "value": sums[a, b], "terms": len(terms)})


def audit(docs: DataFrame, terms: int = TERMS, per_block: int = GROUPS, columns: int = COLUMNS) -> DataFrame:
    """(lang, source, text) -> lang, source, part, item, value, rank."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = cells(docs)
    of_term = Window.partitionBy("lang", "term")
    kept = counted.withColumns({
        "found": F.sum("docs").over(of_term), "lang_count": F.sum("count").over(of_term),
        "one": F.when(F.row_number().over(of_term.orderBy("source")) == 1, 1).otherwise(0)}).filter(F.col("found") >= LEAST_DOCUMENTS)
    kept = materialise(kept.select("lang", "source", "term", "count", "lang_count", "one"), "kept")
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum("one").alias("firsts"))
    occurring = docs.select("lang", "source").distinct()
    groups = occurring.join(sizes, ["lang", "source"], "left").fillna(0, ["n", "firsts"])
    whole = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("firsts").alias("v"))
    groups = groups.join(whole, "lang").withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumn("zero", F.when(F.col("v") > 0, price("0L", "n", "v")).otherwise(F.lit(0).cast("long")))
    groups = materialise(groups.select("lang", "source", "g", "n", "v", "lang_n", "zero"), "groups")
    size = F.max("g").over(Window.partitionBy("lang")) + 1
    groups = groups.withColumns({"blocks": F.ceil(size / per_block).cast("int"), "deals": F.greatest(F.lit(1), F.ceil(F.col("v") / terms)).cast("int")})
    priced = materialise(kept.join(groups.drop("zero"), ["lang", "source"]).withColumns({
        "p": price("count", "n", "v"), "q": price("lang_count", "lang_n", "v")}), "priced")
    return _pairs(priced, groups, per_block, columns).unionByName(_terms(priced))


def _terms(priced: DataFrame) -> DataFrame:
    """The terms a source uses more than its language, those with the largest difference first."""
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    over = priced.filter("p > q").withColumn("value", F.col("p") - F.col("q"))
    top = over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP_TERMS)
    return top.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(priced: DataFrame, groups: DataFrame, per_block: int, columns: int) -> DataFrame:
    """The divergence of each source of a language from each other one."""
    each = groups.select("lang", "g", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("count"), F.col("zero").alias("p"), "blocks",
                         F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    deal = F.pmod(F.xxhash64("term"), F.col("deals")).cast("int")
    rows = priced.select("lang", "g", "term", "count", "p", "blocks", deal.alias("deal")).unionByName(each)
    mine = F.floor(F.col("g") / per_block).cast("int")
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least(mine, "other"), "hi": F.greatest(mine, "other")})

    def run(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        return pair_sums(cell, key[2] != key[3], per_block, columns).assign(lang=key[0])[["lang", "a", "b", "value", "terms"]]

    parts = met.select("lang", "deal", "lo", "hi", "g", "term", "count", "p").groupBy("lang", "deal", "lo", "hi").applyInPandas(
        run, "lang string, a int, b int, value long, terms long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    one, two = (groups.select("lang", F.col("g").alias(x), F.col("source").alias(f"source_{x}"), F.col("zero").alias(f"zero_{x}"), *extra) for x, extra in (("a", ["v"]), ("b", [])))
    both = sums.join(one, ["lang", "a"]).join(two, ["lang", "b"])
    value = F.col("value") + (F.col("v") - F.col("terms")) * F.abs(F.col("zero_a") - F.col("zero_b"))
    sides = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    told = both.select("lang", value.alias("value"), sides.alias("s")).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    return told.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
