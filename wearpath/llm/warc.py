"""WARC archives written and read by Spark, with boundary-chain verification.

Writing: one record per row. Of rows with equal payloads (SHA-1 and length) the one with the smallest id is
a ``response``, the others are ``revisit`` records without a body that name it. Payloads go through the exchange that
brings equal ones together compressed, each by itself. Spark's text writer ends
every row with the blank lines that end a record, so its part files are WARC files.

Reading: Spark's text reader cuts the files at ``WARC/1.1 CRLF`` and splits large files by itself. No two of these
overlap, so no cut hides another one and all splits agree on the cuts. Each piece behind blank lines and the magic
is only a *candidate*: a payload may hold the same bytes. Tasks emit, for every candidate, its byte offset and the offset of its successor by its own Content-Length. `reachable` keeps the
candidates that a chain of successors from the start of the file reaches, by pointer jumping: the reached
set takes one more jump while jumps double, so a file of n records takes about log2(n) rounds of joins. The
payload of a record that a false magic cut is put together from the pieces inside its range.

Every payload read is hashed again and compared with its header; a record that differs gets ``intact`` false.

Defined cases: a null payload is empty; a null id is written as an empty header value and read as null; equal ids
with equal payloads are all responses where the id is the smallest; a file whose chain of records does not end at
the end of the file (cut off, or no archive) is an error that names it; an empty input writes no records.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialise, shared_folder

EOL, BLANK = "\r\n", "\r\n\r\n"
MAGIC = "WARC/1.1\r\n"
URN = "urn:page:"
_CUT = MAGIC
DATE = "2024-01-01T00:00:00Z"
#: Compression of payloads on their way through an exchange, and about the bytes that a task unpacks at once.
LEVEL, UNPACKED = 3, 1 << 24


def payload_digest(data: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC files carry it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def digests(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, payload) -> key, packed (the payload compressed, as it goes through an exchange), payload_bytes, payload_digest."""
    def run(batches):
        codec = pa.Codec("zstd", compression_level=LEVEL)
        for batch in batches:
            data = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.compress(x, asbytes=True) for x in data], pa.binary()), pa.array([len(x) for x in data], pa.int64()),
                                              pa.array([payload_digest(x) for x in data], pa.string())], ["key", "packed", "payload_bytes", "payload_digest"])

    return rows.select(F.col(key).cast("long"), F.coalesce(F.col(payload), F.lit(""))).mapInArrow(
        run, "key long, packed binary, payload_bytes long, payload_digest string")


def unpacked(typed: DataFrame) -> DataFrame:
    """Typed rows with ``payload`` in place of ``packed``, empty for revisits. Bytes stay as they were, whatever they are."""
    names = ["key", "body", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            sizes = [n if kind == "response" else 0 for n, kind in zip(batch.column("payload_bytes").to_pylist(), batch.column("record_type").to_pylist())]
            start = size = 0
            for i, n in enumerate(sizes):
                size += n
                if size < UNPACKED and i + 1 < len(sizes):
                    continue
                part = batch.slice(start, i + 1 - start)
                bodies = [codec.decompress(x, n, asbytes=True) if n else b"" for x, n in zip(part.column("packed").to_pylist(), sizes[start:i + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary()) if name == "body" else part.column(name) for name in names], names)
                start, size = i + 1, 0

    schema = "key long, body binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return typed.mapInArrow(run, schema).withColumn("payload", F.col("body").cast("string"))


def records(hashed: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``record_type`` and ``refers_to``. Groups of one are left out of the join; Spark splits large ones."""
    same = hashed.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(
        F.min("key").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").select(
        F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "first")
    both = hashed.join(same, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return both.select("key", "packed", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
                       F.when(again, F.col("first")).alias("refers_to"))


def write(typed: DataFrame, folder: str) -> None:
    """Write typed rows as WARC part files below ``folder``."""
    name = F.concat(F.lit(URN), F.coalesce(F.col("key").cast("string"), F.lit("")))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    other = F.when(F.col("record_type") == "revisit", F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + EOL + "WARC-Refers-To: <" + URN), F.col("refers_to").cast("string"), F.lit(">" + EOL))).otherwise("")
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.col("record_type"), F.lit(EOL + "WARC-Record-ID: <"), name, F.lit(">" + EOL + "WARC-Date: " + DATE + EOL + "WARC-Payload-Digest: sha1:"),
        F.col("payload_digest"), F.lit(EOL + "WARC-Payload-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL), other,
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(BLANK))
    unpacked(typed).select(F.concat(head, body).alias("value")).write.option("lineSep", BLANK).text(folder)


def _pieces(spark, folder: str) -> DataFrame:
    return spark.read.option("lineSep", _CUT).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _scan(batches):
    """Per piece its place in the split, and what its header says. Payloads are hashed here and go no further."""
    where, at, tail, blank_lines = None, 0, b"", BLANK.encode()
    for batch in batches:
        rows = []
        for file, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            if (file, block) != where:
                where, at, tail = (file, block), 0, blank_lines  # what stands before a split is not known: its first piece may be a record
            magic = (block > 0 or at > 0) and (tail == blank_lines or block == 0 and at == len(_CUT))  # a file's first piece is what precedes its first magic
            head, blank, body = data.partition(blank_lines) if magic else (b"", b"", b"")
            fields = dict(line.partition(b": ")[::2] for line in head.split(EOL.encode()))
            length = fields.get(b"Content-Length", b"")
            if blank and length.isdigit():
                n = int(length)
                rows.append((file, block, at, len(data), at - len(_CUT), at + len(head) + len(BLANK) + n + len(BLANK), head.decode("utf-8", "replace"), n,
                             payload_digest(body[:n]) if len(body) >= n else None))
            else:  # not a record, but its bytes count
                rows.append((file, block, at, len(data), None, None, None, None, None))
            at += len(data) + len(_CUT)
            tail = data[-4:] if len(data) >= 4 else (MAGIC.encode() + data)[-4:]
        columns = list(zip(*rows)) or [()] * 9
        kinds = (pa.string(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], SCANNED)


SCANNED = ["file", "block", "at", "size", "offset_in", "next_in", "head", "body_bytes", "body_digest"]
_SCHEMA = "file string, block long, at long, size long, offset_in long, next_in long, head string, body_bytes long, body_digest string"


def candidates(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """Every place with the magic: file, offset, successor (byte offsets in the file), header text, body length and digest. Beside it the files: path, file (a number that
    stands for the path in all other tables), bytes. Both are written."""
    scanned = materialise(_pieces(spark, folder).mapInArrow(_scan, _SCHEMA), "scan")
    blocks = scanned.groupBy("file", "block").agg(F.sum(F.col("size") + len(_CUT)).alias("bytes"))  # one row a split
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(F.col("file").alias("f"), F.col("block").alias("k"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    # No cut follows a file's last piece. An empty last piece is not read: behind a last cut at the end of a file nothing is.
    files = blocks.groupBy(F.col("file").alias("path")).agg((F.sum("bytes") - len(_CUT)).alias("bytes"))
    files = materialise(files.select("path", F.monotonically_increasing_id().alias("file"), "bytes"), "files")
    numbered = starts.join(files.select(F.col("path").alias("f"), F.col("file").alias("number")), "f")
    placed = scanned.join(numbered, (F.col("file") == F.col("f")) & (F.col("block") == F.col("k"))).withColumn("file", F.col("number"))
    found = placed.filter("head IS NOT NULL").select(
        "file", (F.col("start") + F.col("offset_in")).alias("offset"), (F.col("start") + F.col("next_in")).alias("next"), "head", "body_bytes", "body_digest")
    found = materialise(found, "candidates")
    discard(scanned)
    return found, files


def reachable(found: DataFrame, files: DataFrame) -> DataFrame:
    """(file, offset) of the candidates and file ends that the chain from offset 0 reaches, by pointer jumping over written tables.

    A round deletes the tables of the one before, but for the first, whose places are looked up in every round.
    """
    ends = files.select("file", F.col("bytes").alias("offset"), F.lit(None).cast("long").alias("next"))
    first = jumps = materialise(found.select("file", "offset", "next").unionByName(ends), "jumps")
    nodes = first.select("file", "offset")
    reached = materialise(jumps.filter("offset = 0").select("file", "offset"), "reached")
    n = reached.count()
    while True:
        landed = reached.join(jumps, ["file", "offset"]).select("file", F.col("next").alias("offset")).join(nodes, ["file", "offset"], "left_semi")
        before, reached = reached, materialise(reached.unionByName(landed).distinct(), "reached")
        discard(before)
        if (now := reached.count()) == n:
            discard(first, jumps)
            return reached
        n = now
        hop = jumps.select("file", F.col("offset").alias("next"), F.col("next").alias("after"))
        before, jumps = jumps, materialise(jumps.join(hop, ["file", "next"]).select("file", "offset", F.col("after").alias("next")), "jumps")
        if before is not first:
            discard(before)


def _cut_payloads(spark, folder: str, records_: DataFrame, numbers: DataFrame) -> DataFrame:
    """Digest of the payloads that a false magic cut: (file, offset, mended)."""
    def keep(batches):
        where, at = None, 0
        for batch in batches:
            rows = []
            for file, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                if (file, block) != where:
                    where, at = (file, block), 0
                rows.append((file, block, at, data))
                at += len(data) + len(_CUT)
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], ["file", "block", "at", "data"])

    cut = records_.filter("body_digest IS NULL").select(F.col("file").alias("f"), "offset", (F.col("next") - len(BLANK) - F.col("body_bytes")).alias("from"), "body_bytes")
    files = numbers.join(cut.select(F.col("f").alias("file")).distinct(), "file", "left_semi").select("path", F.col("file").alias("number"))
    raw = _pieces(spark, folder).mapInArrow(keep, "file string, block long, at long, data binary").join(files, F.col("file") == F.col("path")).select(
        F.col("number").alias("file"), "block", "at", "data")
    sizes = raw.groupBy("file", "block").agg(F.sum(F.octet_length("data") + len(_CUT)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("file").alias("g"), F.col("block").alias("k"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    placed = raw.join(starts, (F.col("file") == F.col("g")) & (F.col("block") == F.col("k"))).select("file", (F.col("start") + F.col("at")).alias("begin"), "data")
    inside = placed.join(cut, (F.col("file") == F.col("f")) & (F.col("begin") < F.col("from") + F.col("body_bytes")) & (F.col("begin") + F.octet_length("data") + len(_CUT) > F.col("from")))
    one = inside.groupBy("file", "offset", "from", "body_bytes").agg(F.sort_array(F.collect_list(F.struct("begin", "data"))).alias("parts"))

    def whole(pdf):
        for frame in pdf:
            def join(row):
                data = b"".join(p["data"] + _CUT.encode() for p in row["parts"])
                skip = row["from"] - row["parts"][0]["begin"]
                return payload_digest(data[skip:skip + row["body_bytes"]])
            frame["mended"] = [join(r) for _, r in frame.iterrows()]
            yield frame[["file", "offset", "mended"]]

    return one.mapInPandas(whole, "file long, offset long, mended string")


def read(spark, folder: str) -> DataFrame:
    """The verified records: key, payload_bytes, payload_digest (as the header has them), record_type, refers_to, intact."""
    found, files = candidates(spark, folder)
    reached = reachable(found, files)
    broken = files.join(reached.withColumnRenamed("offset", "bytes"), ["file", "bytes"], "left_anti").limit(5).collect()
    if broken:
        raise ValueError(f"the chain of records ends before the end of the file: {sorted(r['path'] for r in broken)}")
    kept = found.join(reached, ["file", "offset"])
    if kept.filter("body_digest IS NULL").limit(1).count():
        kept = materialise(kept, "records")
        mended = materialise(_cut_payloads(spark, folder, kept, files), "mended")
        kept = kept.join(mended, ["file", "offset"], "left").withColumn("body_digest", F.coalesce("body_digest", "mended"))

    def header(name: str, pattern: str):
        return F.regexp_extract("head", rf"(?:^|\r\n){name}: {pattern}", 1)

    digest, kind = header("WARC-Payload-Digest", r"sha1:([A-Z2-7]+)"), header("WARC-Type", r"(\w+)")
    return kept.select(
        header("WARC-Record-ID", rf"<{URN}(-?\d*)>").alias("id"), header("WARC-Payload-Length", r"(\d+)").cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
        kind.alias("record_type"), header("WARC-Refers-To", rf"<{URN}(-?\d+)>").alias("refers"),
        F.when(kind == "response", (F.col("body_digest") == digest) & (F.col("body_bytes") == header("WARC-Payload-Length", r"(\d+)").cast("long"))).otherwise(F.col("body_bytes") == 0).alias("intact"),
    ).select(F.when(F.col("id") != "", F.col("id").cast("long")).alias("key"), "payload_bytes", "payload_digest", "record_type",
             F.when(F.col("refers") != "", F.col("refers").cast("long")).alias("refers_to"), "intact")


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record per row, read the archives back, and return what was read."""
    folder = shared_folder(pages.sparkSession, "warc")
    write(records(digests(pages, key, payload), least_bytes), folder)
    return read(pages.sparkSession, folder).withColumnRenamed("key", key)
