"""Exact top-k inner products by best-first search in M-trees of paged metric nodes.

1. *A metric.* With one more component, sqrt(M - |x|^2) for a shard's largest squared length M and 0 for a query, all
   of a shard's vectors have the same length, and their distance from a query q is sqrt(|q|^2 + M - 2 q.x): the
   nearest vector has the largest inner product. Scores stay integers; distances only decide what need not be computed.
2. *Candidates.* Equal vectors are one entry with its ``k + 1`` smallest ids: more of them are in no answer. Entries
   are dealt by a hash of the vector into shards of about ``SHARD`` entries.
3. *Pages.* A task bulk-loads a shard's tree: routing vectors are drawn, each entry goes to the nearest, and groups
   above ``PAGE`` entries are split again. Each node is a row of a written table: its entries' vectors, distances to the
   parent's routing vector, and covering radii (0 in a leaf).
4. *Search.* A query goes first to one shard, which gives it a bound, and then to all others with that bound. Nodes
   wait in a heap by their least possible distance; a node beyond the k-th best distance ends the search. In a
   node |d(q, parent) - d(entry, parent)| - radius bounds an entry's distance without computing it.

Queries meet shards in blocks of about ``BLOCK``: a task holds one shard's pages and one block of queries.

Defined cases: null vectors and vectors with null or non-finite components take no part; empty vectors have the inner
product 0 with each other; vectors of different lengths do not meet; a row is a query if its id is divisible by
``every`` (null ids are not) and is no candidate for its own id; equal rows count once; equal ids with
different vectors are queries, and candidates, of their own; ties go to the smaller id, null ids last. Components
that do not fit a long are its limits; scores beyond a long are its limits too.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

K, EVERY = 5, 50
SHARD, PAGE, FANOUT, BLOCK = 16_384, 192, 64, 4096
#: Relative to the squared distances; far above what rounding can change.
SLACK = 1e-9
LIMIT = (1 << 63) - 1
#: Stands for a null id in place of a negated one, below all of them.
NAMELESS = -LIMIT - 1


def integer_vectors(table: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = 256) -> DataFrame:
    """(id, v): distinct rows with floor(scale * component), without those that take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = table.filter(F.col(vector).isNotNull()).filter(~F.coalesce(bad, F.lit(True)))
    return good.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("v")).distinct()


def entries(vectors: DataFrame, k: int = K) -> DataFrame:
    """(v, ids, nameless): each distinct vector with its k + 1 smallest ids, and whether a row without an id is among them."""
    ranked = vectors.withColumn("__rank", F.row_number().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("id")))).filter(F.col("__rank") <= k + 1)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max(F.col("id").isNull()).alias("nameless"))


def products(page: "Page", open_: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of some of a page's vectors with q (limits of a long beyond it)."""
    if page.peak * np.abs(q.astype(float)).max(initial=0) * len(q) < 2**53:
        return (page.floats[open_] @ q.astype(float)).astype(np.int64)
    return np.array([max(-LIMIT - 1, min(LIMIT, sum(int(x) * int(y) for x, y in zip(page.vectors[i], q)))) for i in open_], dtype=np.int64)


def lifted(v: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors with a last component that makes all lengths equal, and that squared length."""
    x = v.astype(float)
    square = (x * x).sum(axis=1)
    most = float(square.max(initial=0))
    return np.c_[x, np.sqrt(np.maximum(most - square, 0))], most


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def bulk_load(points: np.ndarray, most: int = PAGE, fanout: int = FANOUT, seed: int = 0) -> list[dict]:
    """Pages of an M-tree, the root first: entries (rows of points), children (page, -1 in a leaf), radii, to_parent."""
    draw = np.random.default_rng(seed)
    pages: list[dict] = []
    waiting = [(np.arange(len(points)), None, None, None)]  # rows, routing point, the entry's page and place above
    while waiting:
        rows, center, above, place = waiting.pop()
        page = {"rows": rows, "child": np.full(len(rows), -1), "radius": np.zeros(len(rows)), "to_parent": np.zeros(len(rows))}
        if above is not None:
            pages[above]["child"][place] = len(pages)
        if len(rows) > most:
            routing = rows[np.sort(draw.choice(len(rows), min(fanout, -(-len(rows) // most) * 2), replace=False))]
            nearest = distances(points[rows], points[routing])
            home, away = nearest.argmin(axis=1), nearest.min(axis=1)
            sizes = np.bincount(home, minlength=len(routing))
            if sizes.max() == len(rows):  # no split by distance: cut by place
                home = np.arange(len(rows)) * len(routing) // len(rows)
                away, sizes = nearest[np.arange(len(rows)), home], np.bincount(home, minlength=len(routing))
            used = np.flatnonzero(sizes)
            page["rows"] = routing[used]
            page["child"] = np.full(len(used), -1)
            page["radius"] = np.array([away[home == j].max() for j in used])
            page["to_parent"] = np.zeros(len(used))
            for i, j in enumerate(used):
                waiting.append((rows[home == j], points[routing[j]], len(pages), i))
        if center is not None and len(page["rows"]):
            page["to_parent"] = distances(points[page["rows"]], center[None, :])[:, 0]
        pages.append(page)
    return pages


PAGES = "dim int, shard int, page int, most double, child array<int>, radius array<double>, to_parent array<double>, ids array<array<long>>, nameless array<boolean>, vectors binary"


def build(key: tuple, shard: pd.DataFrame, page_size: int = PAGE, fanout: int = FANOUT) -> pd.DataFrame:
    """The pages of one shard's tree."""
    shard = shard.assign(order=[v.tobytes() for v in shard["v"]]).sort_values("order", ignore_index=True)
    v = np.array(list(shard["v"]), dtype=np.int64).reshape(len(shard), int(key[0]))
    points, most = lifted(v)
    out = []
    for number, page in enumerate(bulk_load(points, page_size, fanout)):
        held = shard.iloc[page["rows"]] if (page["child"] < 0).all() else shard.iloc[:0]
        out.append((int(key[0]), int(key[1]), number, most, page["child"].tolist(), page["radius"].tolist(), page["to_parent"].tolist(),
                    [list(map(int, x)) for x in held["ids"]], held["nameless"].tolist(), v[page["rows"]].tobytes()))
    return pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])


class Page:
    def __init__(self, row, dim: int):
        self.child, self.radius, self.to_parent = np.asarray(row.child), np.asarray(row.radius, float), np.asarray(row.to_parent, float)
        self.ids = [[int(i) for i in ids] + [None] * bool(n) for ids, n in zip(row.ids, row.nameless)]
        self.vectors = np.frombuffer(row.vectors, dtype=np.int64).reshape(len(self.child), dim)
        self.floats = self.vectors.astype(float)
        self.peak = np.abs(self.floats).max(initial=0)


class Tree:
    def __init__(self, rows: pd.DataFrame, dim: int):
        self.most = float(rows["most"].iloc[0])
        self.pages = [Page(row, dim) for row in rows.sort_values("page").itertuples()]

    def search(self, number: int, q: np.ndarray, k: int, bound: int | None) -> tuple[list[tuple], int]:
        """The k best (score, -id) of the tree for a query, those below ``bound`` left out, and the number of products computed."""
        own = float((q.astype(float) ** 2).sum())
        slack = SLACK * (own + self.most + 1)
        give = 2 * np.sqrt(slack)
        away = lambda score: np.sqrt(np.maximum(own + self.most - 2.0 * score, 0) + slack)
        best: list[tuple] = []  # a heap, the worst first; a null id is below all others
        limit = np.inf if bound is None else float(away(bound))
        waiting, computed = [(0.0, 0, None)], 0
        while waiting:
            least, at, to_parent = heapq.heappop(waiting)
            if least > limit:
                break
            page = self.pages[at]
            open_ = np.arange(len(page.child))
            if to_parent is not None:
                open_ = np.flatnonzero(np.abs(to_parent - page.to_parent) - page.radius - give <= limit)
            if not len(open_):
                continue
            scores = products(page, open_, q)
            computed += len(open_)
            if page.child[0] >= 0:
                distance = away(scores)
                possible = np.maximum(distance - page.radius[open_] - give, 0)
                for i in np.flatnonzero(possible <= limit):
                    heapq.heappush(waiting, (float(possible[i]), int(page.child[open_[i]]), float(distance[i])))
                continue
            worst = best[0][0] if len(best) == k else bound
            for i in range(len(scores)) if worst is None else np.flatnonzero(scores >= worst):
                for other in page.ids[open_[i]]:
                    if other is not None and other == number:
                        continue
                    entry = (int(scores[i]), NAMELESS if other is None else -other)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            if len(best) == k:
                limit = min(limit, float(away(best[0][0])))
        return best, computed


def _searches(k: int):
    def run(key: tuple, pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pages) and len(queries):
            tree = Tree(pages, int(key[0]))
            for number, q, line, bound in zip(queries["query_id"], queries["v"], queries["line"], queries["bound"]):
                best, _ = tree.search(int(number), np.asarray(q, dtype=np.int64), k, None if bound is None else int(bound))
                out += [(number, line, None if other == NAMELESS else -other, score) for score, other in best]
        found = pd.DataFrame(out, columns=["query_id", "line", "vec_id", "score"])
        return found.assign(vec_id=found["vec_id"].astype("Int64"))

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, shard: int = SHARD, block: int = BLOCK, page: int = PAGE, fanout: int = FANOUT) -> DataFrame:
    """(id, v) -> query_id, rank, vec_id, score for the queries among the rows."""
    vectors = materialise(vectors.withColumn("dim", F.size("v")), "vectors")
    held = materialise(entries(vectors.select("id", "v"), k).withColumn("dim", F.size("v")), "entries")
    queries = vectors.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v", "dim", F.xxhash64("v").alias("line"))
    asked = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    deals = held.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards")).join(asked, "dim")
    deals = materialise(deals, "deals")
    dealt = held.join(deals, "dim").select("dim", F.pmod(F.xxhash64("v"), "shards").cast("int").alias("shard"), "v", "ids", "nameless")

    def load(key: tuple, entries_: pd.DataFrame) -> pd.DataFrame:
        return build(key, entries_, page, fanout)

    pages = materialise(dealt.groupBy("dim", "shard").applyInPandas(load, PAGES), "pages")
    pages = pages.join(deals, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("shards", "blocks")
    deal = F.xxhash64("query_id", "line")
    queries = queries.join(deals, "dim").withColumns({"block": F.pmod(deal, "blocks").cast("int"), "home": F.pmod(F.shiftright(deal, 20), "shards").cast("int")})
    key, columns = ["dim", "shard", "block"], ["dim", "block", "query_id", "line", "v"]

    def search(asking: DataFrame) -> DataFrame:
        # The bound goes as text: a number with nulls would lose digits on the way.
        asking = asking.select(*columns, "shard", F.col("bound").cast("string").alias("bound"))
        return pages.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(_searches(k), "query_id long, line long, vec_id long, score long")

    first = materialise(search(queries.withColumns({"shard": F.col("home"), "bound": F.lit(None).cast("long")})), "first")
    # A bound holds once a query has all its k candidates.
    bounds = first.groupBy("query_id", "line").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    others = queries.join(bounds, ["query_id", "line"], "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    rest = search(others.filter("shard <> home"))
    best = Window.partitionBy("query_id", "line").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
