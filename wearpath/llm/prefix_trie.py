"""The trie of conversation prefixes, from padded matrices of turn ids in range shards.

1. *Paths.* A turn's id is the MD5 of its role and text (16 bytes); a conversation's path holds the ids of its turns,
   in order. Equal paths are one class with its number of members, smallest member and the digest of all members;
   only ids and lengths move, no texts.
2. *Range shards.* Classes are dealt by ranges of their paths, so that a shard holds neighbours of the sorted order.
   In a task, ``sorted_paths`` lays turn ids out in padded matrices of ``WIDTH`` columns, sorts them with lexsort and
   marks node starts by OR-accumulated changes between neighbours; rows that agree on all columns go on to the next
   columns. A row's count of unchanged columns is its prefix in common with the row before.
3. *Aggregates.* A depth's nodes are the runs between node starts: one reduceat for each quantity. Below the last
   depth that a path shares with a neighbour its nodes have one class, and are written out without a loop.
4. *Recombination.* Nodes with the first or the last row of a shard may go on in the next one: their pieces are summed
   by the digest of their prefix. Where two shards meet, the nodes on the common prefix are in both, so that each
   ancestor counts them twice: the rows of ``junctions`` take that off again.

Sums over a subtree come from two additive ones: ``gross``, the bytes of all members from this depth on, and ``net``,
those of the distinct nodes; their difference is what storing every node once saves.

Defined cases: rows without a conv_id name no conversation and are left out; null roles and texts are empty; turns
sort by (turn, null first; role; id), so that ties and repeated rows have one order; conversations without turns are
members of the root alone; without conversations there is no root; other columns are not read. One conversation's path
is one row (16 bytes and a length a turn), and one class's members pass one task as a sorted stream of ids, as the
digest of their list needs; nothing else of a group meets in one place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

WIDTH = 16
TURNS_PER_SHARD = 16_384
MOST_SHARED = 8
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, turns: array of (id: hex digest, size: bytes of the text), in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("id"),
                                                                 F.octet_length(text).cast("long").alias("size")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % 5 in place of its own; h = crc32(c) % 9."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    base = own.select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, MOST_SHARED).alias("head"))
    both = own.withColumns({"h": h, "base_id": F.col("conv_id") - F.col("conv_id") % 5}).join(base, "base_id", "left")
    mine = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return both.select("conv_id", F.when(F.col("head").isNull(), mine).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), mine)).alias("turns"))


def classes(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) -> one row per distinct path: path, sizes, n, first, ends (digest of the members' ids)."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    every = materialise(conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
                        .withColumn("class", F.unhex(F.md5("path"))), "paths")
    found = every.groupBy("class").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    ends = every.select(F.col("class").alias("c"), "conv_id").repartition("c").sortWithinPartitions("c", "conv_id").mapInArrow(_ends, "c binary, ends string")
    return found.join(ends, F.col("class") == F.col("c")).select("path", "sizes", "n", "first", "ends")


def _ends(batches):
    """SHA-256 of each class's ids, joined by commas, over rows sorted by class and id."""
    held, state = None, None
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        done, digests = [], []
        for key, number in zip(keys, ids):
            if key == held:
                state.update(b",%d" % number)
                continue
            if held is not None:
                done.append(held)
                digests.append(state.hexdigest())
            held, state = key, hashlib.sha256(b"%d" % number)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary()), pa.array(digests, pa.string())], ["c", "ends"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["c", "ends"])


def sorted_paths(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct paths and each one's common prefix with the one before (in turns; -1 for the first).

    Path i is data[offsets[i]:offsets[i + 1]], rows of two 64-bit words.
    """
    lengths = np.diff(offsets)
    order, common = np.arange(len(lengths)), np.full(len(lengths), -1, dtype=np.int64)
    places, group, first = order.copy(), np.zeros(len(order), dtype=np.int64), 0  # places in the order that are still tied
    while len(places):
        rows = order[places]
        cells = first + np.arange(WIDTH)
        inside = cells[None, :] < lengths[rows][:, None]
        at = np.where(inside, offsets[rows][:, None] + cells[None, :], 0)
        matrix = np.where(inside[:, :, None], data[at], 0) if len(data) else np.zeros((len(rows), WIDTH, 2), dtype=np.uint64)
        keys = [lengths[rows], *(matrix[:, c, k] for c in reversed(range(WIDTH)) for k in (1, 0)), group]
        by = np.lexsort(keys)
        matrix, group, rows = matrix[by], group[by], rows[by]
        order[places] = rows
        changed = (matrix[1:] != matrix[:-1]).any(axis=2) | ~inside[by][1:]  # a path that ends agrees with none below its end
        starts = np.logical_or.accumulate(changed, axis=1)
        same = group[1:] == group[:-1]
        agree = np.where(starts.all(axis=1), 0, (~starts).sum(axis=1))
        common[places[1:][same]] = first + agree[same]
        whole = same & (agree == WIDTH)
        tied = np.r_[whole, False] | np.r_[False, whole]
        group = np.cumsum(np.r_[True, ~whole])[tied]
        places, first = places[tied], first + WIDTH
    return order, common


class Shard:
    """The nodes of some distinct paths. Quantities are per class; a node is a run of rows of the sorted order."""

    COLUMNS = ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "gross", "net", "last", "key", "parent_key")

    def __init__(self, data, offsets, sizes, n, first):
        order, self.common = sorted_paths(data, offsets)
        self.order, self.n, self.first = order, n[order], first[order]
        self.length = np.diff(offsets)[order]
        self.start = offsets[:-1][order]
        self.sums = np.r_[0, np.cumsum(sizes)]
        self.total = self.sums[self.start + self.length] - self.sums[self.start]
        self.after = np.r_[self.common[1:], -1]
        self.leaf = (self.after < self.length).astype(np.int64)
        # The bytes of the nodes that a row is the first of.
        self.own = self.total - self.before(np.arange(len(order)), np.maximum(self.common, 0))

    def before(self, rows, depth):
        """Bytes of a path's first ``depth`` turns."""
        return self.sums[self.start[rows] + depth] - self.sums[self.start[rows]]

    def nodes(self) -> dict[str, np.ndarray]:
        rows_in_all = len(self.order)
        last_row = rows_in_all - 1
        out: dict[str, list] = {c: [] for c in ("row", "end", *self.COLUMNS[:9], "parent_edge")}
        alive = np.arange(rows_in_all)
        parent, edge = np.full(rows_in_all, -1), np.zeros(rows_in_all, dtype=bool)  # of each row: its node one depth above
        depth = 0
        while len(alive):
            starts = np.flatnonzero(self.common[alive] < depth)
            counts = np.diff(np.r_[starts, len(alive)])
            many = np.repeat(counts > 1, counts)
            alive = alive[many]
            if not len(alive):
                break
            starts, counts = np.cumsum(np.r_[0, counts[counts > 1]])[:-1], counts[counts > 1]
            rows, ends = alive[starts], alive[starts + counts - 1]
            total = lambda x: np.add.reduceat(x[alive], starts)
            least = np.minimum.reduceat(self.first[alive], starts)
            suffix = self.total - self.before(np.arange(rows_in_all), np.minimum(max(depth - 1, 0), self.length))
            inner = (self.common == depth).astype(np.int64)
            inner[rows] = self.length[rows] > depth
            own = self.own.copy()
            own[rows] = suffix[rows]
            for name, value in (("row", rows), ("end", ends), ("depth", np.full(len(rows), depth)), ("conv_id", least), ("parent_conv_id", parent[rows]),
                                ("n_convs", total(self.n)), ("n_children", total(inner)), ("n_leaves", total(self.leaf)), ("gross", total(self.n * suffix)),
                                ("net", total(own)), ("last", np.where(self.length[rows] == depth, rows, -1)), ("parent_edge", edge[rows])):
                out[name].append(value)
            parent[alive], edge[alive] = np.repeat(least, counts), np.repeat((rows == 0) | (ends == last_row), counts)
            depth += 1
        # Nodes of one class: from below the last shared depth to the path's end.
        top = np.maximum(self.common, self.after) + 1
        counts = np.maximum(self.length - top + 1, 0)
        rows = np.repeat(np.arange(rows_in_all), counts)
        depth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + top[rows]
        highest, end = depth == top[rows], depth == self.length[rows]
        net = self.total[rows] - self.before(rows, np.maximum(depth - 1, 0))
        at_edge = (rows == 0) | (rows == last_row)
        for name, value in (("row", rows), ("end", rows), ("depth", depth), ("conv_id", self.first[rows]), ("parent_conv_id", np.where(highest, parent[rows], self.first[rows])),
                            ("n_convs", self.n[rows]), ("n_children", (~end).astype(np.int64)), ("n_leaves", np.ones(len(rows), dtype=np.int64)),
                            ("gross", self.n[rows] * net), ("net", net), ("last", np.where(end, rows, -1)), ("parent_edge", np.where(highest, edge[rows], at_edge))):
            out[name].append(value)
        return {c: np.concatenate(v) for c, v in out.items()}


def prefix_keys(path: bytes) -> list[bytes]:
    """A digest of each prefix of a path, from no turn to all."""
    state, out = hashlib.md5(), []
    out.append(state.digest())
    for i in range(0, len(path), 16):
        state.update(path[i:i + 16])
        out.append(state.copy().digest())
    return out


def _layout(table: pa.Table):
    path = table.column("path").combine_chunks().cast(pa.large_binary())
    lengths = np.array([len(p) for p in path.to_pylist()], dtype=np.int64) // 16
    data = np.frombuffer(b"".join(path.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    sizes = table.column("sizes").combine_chunks()
    sizes = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return data, np.r_[0, np.cumsum(lengths)], sizes


NODE = ("depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, gross long, net long, ends string, key binary, "
        "parent_key binary, head binary, tail binary, tail_sizes array<long>")


def _shard(batches):
    """The nodes of one range shard, and one row (depth -1) with its first and last path."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    shard = Shard(*_layout(table), table.column("n").to_numpy(), table.column("first").to_numpy())
    found = shard.nodes()
    row_of, last = shard.order, len(shard.order) - 1
    head, tail = (table.column("path")[int(row_of[i])].as_py() for i in (0, last))
    keys = {0: prefix_keys(head), last: prefix_keys(tail)}
    ends = table.column("ends").to_pylist()

    def key(row, end, depth):
        return keys[0][depth] if row == 0 else keys[last][depth] if end == last else None

    # Only nodes at an edge, and those below one, carry digests.
    own = [None] * len(found["row"])
    above = [None] * len(own)
    for i in np.flatnonzero((found["row"] == 0) | (found["end"] == last)):
        own[i] = key(found["row"][i], found["end"][i], found["depth"][i])
    row_shares_head = _shared(shard, 0)
    for i in np.flatnonzero(found["parent_edge"]):
        depth = int(found["depth"][i]) - 1
        above[i] = keys[0][depth] if row_shares_head[found["row"][i]] >= depth else keys[last][depth]
    n = len(own)
    columns = [pa.array(found[c]) for c in ("depth", "conv_id")]
    columns.append(pa.array(found["parent_conv_id"], mask=found["depth"] == 0))
    columns += [pa.array(found[c]) for c in ("n_convs", "n_children", "n_leaves", "gross", "net")]
    columns.append(pa.array([ends[row_of[r]] if r >= 0 else None for r in found["last"]], pa.string()))
    columns += [pa.array(own, pa.binary()), pa.array(above, pa.binary()), *(pa.nulls(n, t) for t in (pa.binary(), pa.binary(), pa.list_(pa.int64())))]
    names = [part.split()[0] for part in NODE.split(", ")]
    yield pa.RecordBatch.from_arrays(columns, names)
    edge = [-1] + [None] * 10 + [head, tail, table.column("sizes")[int(row_of[last])].as_py()]
    yield pa.RecordBatch.from_arrays([pa.array([v], c.type) for v, c in zip(edge, columns)], names)


def _shared(shard: Shard, row: int) -> np.ndarray:
    """How many turns each row has in common with the first row."""
    reach = shard.common.copy()
    reach[0] = shard.length[0]
    return np.minimum.accumulate(reach)


def _junctions(batches):
    """What the nodes on the common prefix of two neighbouring shards count twice, for each of them and the nodes above."""
    for batch in batches:
        out = {c: [] for c in ("key", "net", "n_children", "n_leaves")}
        for tail, sizes, head in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own, other = np.frombuffer(tail, dtype="V16"), np.frombuffer(head, dtype="V16")
            least = min(len(own), len(other))
            differ = np.flatnonzero(own[:least] != other[:least])
            shared = int(differ[0]) if len(differ) else least
            sums = np.r_[0, np.cumsum(np.array(sizes, dtype=np.int64))]
            for depth, key in enumerate(prefix_keys(tail[:16 * shared])):
                out["key"].append(key)
                out["net"].append(-int(sums[shared] - sums[max(depth - 1, 0)]))
                out["n_children"].append(-int(depth < shared))
                out["n_leaves"].append(-int(shared == len(own)))
        yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.binary()), *(pa.array(out[c], pa.int64()) for c in ("net", "n_children", "n_leaves"))], list(out))


def trie(found: DataFrame, turns_per_shard: int = TURNS_PER_SHARD) -> DataFrame:
    """(path, sizes, n, first, ends), one row per distinct path -> the nodes of the trie."""
    found = materialise(found, "classes")
    turns = found.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    shards = max(1, -(-turns // turns_per_shard))
    rows = materialise(found.repartitionByRange(shards, "path").mapInArrow(_shard, NODE), "nodes")
    nodes = rows.filter("depth >= 0").drop("head", "tail", "tail_sizes")
    inside = nodes.filter("key IS NULL")
    pieces = nodes.filter("key IS NOT NULL")
    # One row a shard, so this window is over as many rows as there are shards.
    edges = rows.filter("depth < 0").selectExpr("tail", "tail_sizes", "lead(head) OVER (ORDER BY head) AS head").filter("head IS NOT NULL")
    twice = edges.mapInArrow(_junctions, "key binary, net long, n_children long, n_leaves long")
    summed = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "gross", "net")]
    joined = pieces.unionByName(twice, allowMissingColumns=True).groupBy("key").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *summed, F.max("ends").alias("ends"), F.max("parent_key").alias("parent_key"))
    joined = materialise(joined, "edge-nodes")
    parents = joined.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("edge_conv_id"))
    names = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "gross", "net", "ends"]
    settled = inside.filter("parent_key IS NULL").select(*names, "parent_conv_id")
    below = inside.unionByName(joined, allowMissingColumns=True).filter("parent_key IS NOT NULL").join(parents, "parent_key").select(
        *names, F.col("edge_conv_id").alias("parent_conv_id"))
    root = joined.filter("depth = 0").select(*names, F.lit(None).cast("long").alias("parent_conv_id"))
    return settled.unionByName(below).unionByName(root).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("gross") - F.col("net")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_MEMBERS)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of a table of conversations (conv_id, turn, role, text) after rebuilding."""
    return trie(classes(rebuilt(materialise(paths(turns), "turns"))))
