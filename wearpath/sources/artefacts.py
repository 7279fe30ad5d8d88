"""Fitted results kept as one versioned folder: tables and MLlib models with digests, checked when read back.

Layout below ``path/version``: a Parquet folder per table, a model folder per model, and last ``manifest``, which names
them with rows, columns and digest. A version without a manifest was never finished and cannot be read. Nothing is
overwritten. Digests are sums over rows (tables) or files (models), so they depend neither on the order of rows and
part files nor on the number of tasks, and come from partial aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import DataQualityError

MANIFEST = "part string, kind string, rows long, columns int, bytes long, digest string"


def marks_of(sha256: Column) -> list[Column]:
    """A digest as four numbers of 52 bits whose sums over any rows fit a decimal."""
    return [F.conv(F.substring(sha256, 1 + 13 * i, 13), 16, 10).cast("decimal(20,0)") for i in range(4)]


def folded(rows: Column, marks: list[Column]) -> Column:
    """One digest from a count and summed marks."""
    return F.sha2(F.concat_ws("/", rows.cast("string"), *[F.coalesce(F.sum(m), F.lit(0)).cast("string") for m in marks]), 256)


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values under their names, nulls included."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)


def content_digest(df: DataFrame) -> DataFrame:
    """(rows, digest) of a frame: equal for equal rows in any order and layout."""
    names = df.columns
    return df.select(row_digest(names).alias("__d")).agg(F.count("*").alias("rows"), folded(F.count("*"), marks_of(F.col("__d"))).alias("digest"))


def table_digest(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(rows, columns, bytes, digest) of a written table, in one scan: the scan itself knows each file's size."""
    data = spark.read.option("header", True).format(kind).load(path)
    file = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    seen = data.select(file.alias("__f"), row_digest(data.columns).alias("__d"))
    marks = [m.alias(f"m{i}") for i, m in enumerate(marks_of(F.col("__d")))]
    # A row per file first: a file's size counts once however many splits read it.
    files = seen.select("__f", *marks).groupBy("__f").agg(F.count("*").alias("n"), *[F.sum(f"m{i}").alias(f"m{i}") for i in range(4)])
    return files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.lit(len(data.columns)).alias("columns"), F.coalesce(F.sum("__f.size"), F.lit(0)).alias("bytes"),
                     folded(F.coalesce(F.sum("n"), F.lit(0)), [F.col(f"m{i}") for i in range(4)]).alias("digest"))


def model_digest(spark: SparkSession, path: str) -> DataFrame:
    """(rows: files, columns, bytes, digest) of a model folder: contents with their places below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(~F.col("path").rlike(r"/[._][^/]*$"))
    place = F.regexp_replace("path", r"^.*?" + path.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    own = files.select("length", F.sha2(F.concat(F.sha2("content", 256), place), 256).alias("__d"))
    return own.agg(F.count("*").alias("rows"), F.lit(0).alias("columns"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), folded(F.count("*"), marks_of(F.col("__d"))).alias("digest"))


@dataclass(frozen=True)
class Artefact:
    version: str
    tables: dict[str, DataFrame]
    models: dict[str, PipelineModel]


def save(spark: SparkSession, path: str, version: str, tables: dict[str, DataFrame], models: dict[str, PipelineModel] | None = None) -> None:
    """Write all parts, then the manifest with the digests of what was written."""
    base = f"{path}/{version}"
    rows = []
    for name, frame in tables.items():
        frame.write.mode("errorifexists").parquet(f"{base}/{name}")
        rows.append(_row(name, "table", table_digest(spark, f"{base}/{name}")))
    for name, model in (models or {}).items():
        model.write().save(f"{base}/{name}")
        rows.append(_row(name, "model", model_digest(spark, f"{base}/{name}")))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{base}/manifest")


def _row(name: str, kind: str, found: DataFrame) -> tuple:
    one = found.first()  # one row of sums
    return name, kind, one["rows"], one["columns"], one["bytes"], one["digest"]


def load(spark: SparkSession, path: str, version: str) -> Artefact:
    """The parts of a version; raises where one is missing or differs from the manifest."""
    base = f"{path}/{version}"
    tables, models = {}, {}
    for entry in spark.read.schema(MANIFEST).parquet(f"{base}/manifest").collect():  # one row a part
        place = f"{base}/{entry['part']}"
        try:
            found = _row(entry["part"], entry["kind"], (table_digest if entry["kind"] == "table" else model_digest)(spark, place))
        except Exception as error:
            raise DataQualityError(f"{entry['part']} of {version} cannot be read: {str(error)[:200]}") from error
        if found != tuple(entry):
            raise DataQualityError(f"{entry['part']} of {version} is not what was saved: {found} against {tuple(entry)}")
        if entry["kind"] == "table":
            tables[entry["part"]] = spark.read.parquet(place)
        else:
            models[entry["part"]] = PipelineModel.load(place)
    return Artefact(version, tables, models)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The finished versions with their parts."""
    found = spark.read.schema(MANIFEST).parquet(f"{path}/*/manifest")
    return found.select(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/manifest/", 1).alias("version"), *[c.split()[0] for c in MANIFEST.split(", ")])
