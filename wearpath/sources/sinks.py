"""Writers: tables, manifests, reports, prediction history and payload CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import digest, finite, is_sha256, utc_seconds
from ..operators import quality
from ..operators.quality import require
from .artefacts import table_digest
from .schemas import HISTORY_COMPONENTS


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), kind: str = "parquet", replace: bool = False) -> None:
    """Never overwrites an existing result unless told to."""
    writer = df.write.mode("overwrite" if replace else "errorifexists").partitionBy(*partition_by)
    writer.option("header", True).format(kind).save(path)


def merged_digest(sha256: Column) -> Column:
    """Aggregate of many digests that is the same in any order and needs no list: the sum of their leading bits."""
    lead = F.conv(F.substring(sha256, 1, 13), 16, 10).cast("decimal(20,0)")
    return F.sum(lead).cast("string")


def file_manifest(spark: SparkSession, path: str, description: str = "") -> DataFrame:
    """path, bytes, SHA-256 per data file (content is hashed where it is read)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.lit(description).alias("description"))


def table_entry(spark: SparkSession, path: str, description: str, kind: str = "parquet") -> DataFrame:
    """One manifest row per written table: rows, columns, bytes and a digest of its rows, from one scan.

    The digest does not depend on the order of rows, the number of part files or the number of tasks that read them.
    """
    found = table_digest(spark, path, kind)
    return found.select(F.lit(path).alias("path"), "rows", "columns", "bytes", F.col("digest").alias("sha256"), F.lit(description).alias("description"))


def long_predictions(df: DataFrame, key: Sequence[str], models: dict[str, str], actual: str = "actual") -> DataFrame:
    """(key, actual, model, predicted, error): the stored form of several models' predictions."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("predicted")) for m, c in models.items()])
    return df.select(*key, actual, F.inline(cells)).withColumn("error", F.col("predicted") - F.col(actual))


def wide_predictions(long: DataFrame, key: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One column per model, for export."""
    return long.groupBy(*key).pivot("model", list(models)).agg(F.first("predicted"))


def write_report(metrics: DataFrame, path: str) -> None:
    """A metrics table as JSON lines; NaN and infinities are refused."""
    doubles = [f.name for f in metrics.schema if f.dataType.typeName() in ("double", "float")]
    for name in doubles:
        require(metrics.filter(F.col(name).isNotNull() & ~finite(F.col(name))).select(name), f"{name} is not finite")
    metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value")).write.mode("errorifexists").text(path)


def section_report(df: DataFrame, by: Sequence[str], fields: Sequence[str], input_json: Column, raw: Sequence[str] = ()) -> DataFrame:
    """One JSON document per row with a digest of the input instead of its sensor values."""
    kept = [c for c in fields if c not in raw]
    return df.select(*by, F.to_json(F.struct(*kept, digest(input_json).alias("input_digest"))).alias("document"))


# -- prediction history: an append-only log of creations and outcome changes ------------
HISTORY = ("id string, at timestamp, kind string, component string, asset_id string, source string, summary string, "
           "review_required boolean, model_release string, input_digest string, outcome_status string")
_FIELDS = [f.strip().split() for f in HISTORY.split(",")]
# Where a result may come from, what a review may find.
SOURCES = ("dataset_example", "uploaded_file", "edited_input", "all_components_bundle")
OUTCOMES = ("confirmed_fault", "no_fault_found", "inconclusive")
UNREVIEWED = "unreviewed"


def created(df: DataFrame) -> DataFrame:
    """New entries; ``id`` and ``at`` are made up (a random id, now) unless the rows bring them. Text rules are checked first."""
    bad = quality.violations(df, ["component"], [
        quality.outside_domain("component", HISTORY_COMPONENTS),
        quality.Rule("length:summary", ~F.length("summary").between(1, 500), F.col("summary")),
        quality.Rule("length:asset_id", F.length("asset_id") > 80, F.col("asset_id")),
        quality.Rule("digest:input_digest", ~is_sha256(F.col("input_digest")), F.col("input_digest"))])
    require(bad, "history entries")
    made = {"id": F.uuid(), "at": F.current_timestamp()}
    full = df.withColumns({c: v for c, v in made.items() if c not in df.columns} | {"kind": F.lit("created"), "outcome_status": F.lit(None).cast("string")})
    return _log_rows(full)


def outcomes(df: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """Outcome changes (id, outcome_status) as log rows; ``at`` is now unless the rows bring it. ``allowed``: usually `OUTCOMES`."""
    rules = [quality.missing("id"), quality.missing("outcome_status"), *([quality.outside_domain("outcome_status", allowed)] if allowed else [])]
    require(quality.violations(df, ["id"], rules), "outcomes")
    return _log_rows(df.withColumns(({} if "at" in df.columns else {"at": F.current_timestamp()}) | {"kind": F.lit("outcome")}))


def _log_rows(full: DataFrame) -> DataFrame:
    return full.select(*[(F.col(n) if n in full.columns else F.lit(None)).cast(t).alias(n) for n, t in _FIELDS])


def append_history(log: DataFrame, path: str) -> None:
    """Appends go to the segment that is numbered by the finished compactions, so that readers need only the last ones."""
    number = len(_folders(log.sparkSession, f"{path}/_folded"))
    log.write.mode("append").parquet(f"{path}/segment={number}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The newest compaction and the segments it may not hold. Rows that both hold change nothing when folded.

    The segment before the newest is read too: an append may have gone to it while the compaction ran.
    """
    done = _folders(spark, f"{path}/_folded")
    segments = [name for name in _folders(spark, path) if name.startswith("segment=") and int(name.split("=")[1]) >= len(done) - 1]
    places = [f"{path}/{name}" for name in segments] + [f"{path}/_folded/{done[-1]}" for _ in done[-1:]]
    return spark.read.schema(HISTORY).parquet(*places) if places else spark.createDataFrame([], HISTORY)


def compact_history(spark: SparkSession, path: str) -> str:
    """Fold the log to an entry's creation and latest outcome (and outcomes of unknown ids) in a new folder; returns its name.

    Segments stay; later readers pass over them. A compaction that fails leaves no finished folder and changes nothing.
    """
    name = f"{len(_folders(spark, f'{path}/_folded')):06d}"
    log = read_history(spark, path)
    current = current_history(log)
    entries = current.withColumns({"at": F.col("created_at"), "kind": F.lit("created"), "outcome_status": F.lit(None).cast("string")})
    changes = current.filter("outcome_updated_at IS NOT NULL").select("id", F.col("outcome_updated_at").alias("at"), F.lit("outcome").alias("kind"), "outcome_status")
    both = _log_rows(entries).unionByName(_log_rows(changes)).unionByName(unknown_outcomes(log).distinct())
    both.write.mode("errorifexists").parquet(f"{path}/_folded/{name}")
    return name


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished folders below a path, oldest first."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    found = [s.getPath() for s in files.listStatus(place)]
    success = lambda p: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted((p.getName() for p in found if success(p)), key=lambda name: int(name.split("=")[-1]) if name.split("=")[-1].isdigit() else -1)


def current_history(log: DataFrame) -> DataFrame:
    """Each entry with its latest outcome: partial aggregates, no per-entry window. Outcomes at one moment: the largest text."""
    first = F.col("kind") == "created"
    fields = ("component", "asset_id", "source", "summary", "review_required", "model_release", "input_digest")
    latest = F.max(F.when(~first, F.struct("at", "outcome_status")))
    return log.groupBy("id").agg(
        F.min(F.when(first, F.col("at"))).alias("created_at"), *[F.max(F.when(first, F.col(c))).alias(c) for c in fields],
        latest["outcome_status"].alias("outcome_status"), latest["at"].alias("outcome_updated_at")).filter(F.col("created_at").isNotNull())


def unknown_outcomes(log: DataFrame) -> DataFrame:
    """Outcome rows whose id no creation has; they are kept, reported, and change no entry."""
    return log.filter("kind = 'outcome'").join(log.filter("kind = 'created'").select("id").distinct(), "id", "left_anti")


def newest_history(log: DataFrame, limit: int = 50, asset_id: str | None = None) -> DataFrame:
    """The newest entries. Spark keeps ``limit`` rows a partition for this order and limit, never the whole log."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie between 1 and 200")
    rows = current_history(log if not asset_id or not asset_id.strip() else _entries_of(log, asset_id.strip()))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).withColumn("created_at_utc", utc_seconds(F.col("created_at")))


def _entries_of(log: DataFrame, asset_id: str) -> DataFrame:
    ids = log.filter((F.col("kind") == "created") & (F.col("asset_id") == asset_id)).select("id")
    return log.join(ids, "id", "left_semi")


def payload_rows(requests: DataFrame, array: str, fields: Sequence[str]) -> DataFrame:
    """Nested samples as flat rows with the request's own fields repeated, ready for a CSV writer."""
    return requests.select(*fields, F.inline(array))
