"""Quality classifier by hierarchical empirical Bayes.

* *Evidence of the document.* The text's rates (symbols, repeats, capitals, ...) are binned; good and bad labels per
  bin, over all labelled documents, give a log-likelihood ratio. It is clipped, so that no rate and no text outweighs everything.
* *Evidence of the site.* Labels per path (source and language) and host (source) are counted. The global good
  rate shrinks hosts, and each host's posterior shrinks its paths, by a beta prior whose strength is estimated from how much
  hosts (paths) differ beyond chance (method of moments); a site with few labels stays near its parent.
* *Decision.* The path posterior is the prior odds, the document's likelihood ratio turns them into a probability;
  documents below ``CUTOFF`` are rejected.

Defined cases: a null source or language is a site of its own; sites without labels take their parent's rate;
several labels of a document count once, good if any says so; without labels, or with one class only, the
likelihood ratio is 0 and nothing is rejected but by the prior; null and empty texts have no evidence (ratio 0) but their
site's. Rows repeat as they do in the input; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality_rules

CUTOFF, CLIP, BINS, BIN_CLIP = 0.5, 12.0, 20, 6.0
#: Name -> (count, what it is divided by).
RATES = {
    "symbols": ("n_symbols", "n_words"), "repeats": ("n_repeat_words", "n_words"), "exclaims": ("n_exclaims", "n_words"),
    "capitals": ("n_capitals", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"),
}


def bin_of(name: str) -> Column:
    """The rate in twentieths; 1 and more share the last bin."""
    count, by = RATES[name]
    return F.least(F.lit(BINS), F.floor(BINS * F.col(count) / F.greatest(F.lit(1), F.col(by)))).cast("int")


def evidence(measured: DataFrame, labelled: DataFrame) -> DataFrame:
    """Adds ``evidence``, the clipped sum over rates of log P(bin | good) / P(bin | bad)."""
    bins = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bin_of(r).alias("bin")) for r in RATES])).alias("x")
    good = F.sum(F.col("__good").cast("long"))
    counted = labelled.filter("n_words > 0").select("__good", bins).groupBy("x.rate", "x.bin").agg(good.alias("g"), (F.count(F.lit(1)) - good).alias("b"))
    rows = counted.collect()  # at most rates x (BINS + 1) rows
    total = F.lit(0.0)
    for r in RATES:
        mine = {x["bin"]: (x["g"], x["b"]) for x in rows if x["rate"] == r}
        g, b = (sum(v[i] for v in mine.values()) for i in (0, 1))
        if not g or not b:
            continue
        ratios = [math.log((mine.get(i, (0, 0))[0] + 0.5) / (g + 0.5 * BINS)) - math.log((mine.get(i, (0, 0))[1] + 0.5) / (b + 0.5 * BINS)) for i in range(BINS + 1)]
        # A bin without labels says nothing.
        ratios = [max(-BIN_CLIP, min(BIN_CLIP, x)) if i in mine else 0.0 for i, x in enumerate(ratios)]
        total = total + F.element_at(F.array(*[F.lit(x) for x in ratios]), bin_of(r) + 1)
    clipped = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), total))
    return measured.withColumn("evidence", F.when(F.col("n_words") > 0, clipped).otherwise(F.lit(0.0)))


def strength(groups: DataFrame, n: str, good: str, parent: str) -> Column:
    """Prior strength by moments, as a one-row aggregate over sites: large where sites differ no more than chance."""
    p, q = F.col(parent), 1 - F.col(parent)
    between = F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - p, 2)) - F.sum(p * q)  # what differs beyond chance
    room = F.sum((F.col(n) - 1) * p * q)
    return F.when((between > 0) & (room > between), room / between - 1).otherwise(F.lit(1e4))


def site_rates(labelled: DataFrame, host: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(host rates with ``__hr``, path rates with ``__pr``), shrunk; one row a site."""
    total = labelled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("__good").cast("long")), F.lit(0)).alias("g")).select(
        ((F.col("g") + 1) / (F.col("n") + 2)).alias("__global"))
    paths = labelled.groupBy(host, path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__good").cast("long")).alias("g"))
    hosts = paths.groupBy(host).agg(F.sum("n").alias("n"), F.sum("g").alias("g")).join(F.broadcast(total))
    hosts = hosts.join(F.broadcast(hosts.agg(strength(hosts, "n", "g", "__global").alias("__k"))))
    hosts = hosts.select(F.col(host).alias("__h"), ((F.col("g") + F.col("__k") * F.col("__global")) / (F.col("n") + F.col("__k"))).alias("__hr"))
    paths = paths.join(hosts, F.col(host).eqNullSafe(F.col("__h")))
    paths = paths.join(F.broadcast(paths.agg(strength(paths, "n", "g", "__hr").alias("__k"))))
    paths = paths.select(F.col(host).alias("__ph"), F.col(path).alias("__pp"), ((F.col("g") + F.col("__k") * F.col("__hr")) / (F.col("n") + F.col("__k"))).alias("__pr"))
    return hosts, paths


def judge(measured: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", fit: DataFrame | None = None) -> DataFrame:
    """Measured documents -> the same with evidence, site_rate, quality (probability of good) and kept.

    ``fit``: a written copy of the measures, for fitting, where ``measured`` also carries texts.
    """
    labelled = (measured if fit is None else fit).join(quality_rules.good_labels(labels), F.col("doc_id") == F.col("__labelled"))
    hosts, paths = site_rates(labelled, host, path)
    total = labelled.agg(((F.coalesce(F.sum(F.col("__good").cast("long")), F.lit(0)) + 1) / (F.count(F.lit(1)) + 2)).alias("__global"))
    scored = evidence(measured, labelled).join(F.broadcast(total))
    scored = scored.join(hosts, F.col(host).eqNullSafe(F.col("__h")), "left").join(
        paths, F.col(host).eqNullSafe(F.col("__ph")) & F.col(path).eqNullSafe(F.col("__pp")), "left")
    prior = F.coalesce("__pr", "__hr", "__global")
    prior = F.greatest(F.lit(math.exp(-CLIP)), F.least(F.lit(1 - math.exp(-CLIP)), prior))
    odds = F.col("evidence") + F.log(F.col("site_rate") / (1 - F.col("site_rate")))
    return scored.withColumn("site_rate", prior).withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn(
        "kept", F.col("quality") >= CUTOFF).drop("__global", "__h", "__hr", "__ph", "__pp", "__pr")
