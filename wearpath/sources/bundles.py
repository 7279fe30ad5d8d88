"""Documents that hold one request of each component: built from examples, read back, split into typed tables.

A document is parsed once into a VARIANT column and written; every component's table is that column's own section
under the component's schema, so splitting five ways reads the texts once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import DataQualityError, Rule
from ..session import materialise
from . import readers
from .schemas import HISTORY_COMPONENTS, request_schema


def build(examples: dict[str, DataFrame], key: str = "bundle_id", strict: bool = True) -> DataFrame:
    """(key, payload struct) per component -> (key, value: the document). Strict: raises where a key lacks a component's example."""
    absent = [c for c in HISTORY_COMPONENTS if c not in examples]
    if absent:
        raise DataQualityError(f"no examples of {', '.join(absent)}")
    parts = [examples[c].select(key, F.col("payload").alias(f"`{c}`".strip("`"))) for c in HISTORY_COMPONENTS]
    whole = reduce(lambda a, b: a.join(b, key, "full_outer" if strict else "inner"), parts)
    if strict:
        whole = readers.settled(whole, [Rule(f"missing:{c}", F.col(f"`{c}`").isNull(), F.lit("")) for c in HISTORY_COMPONENTS], "bundles", True)
    return whole.select(key, F.to_json(F.struct(*[F.col(f"`{c}`") for c in HISTORY_COMPONENTS])).alias("value"))


def section_rules(document: str = "document") -> list[Rule]:
    """A bundle is a JSON object of exactly the five sections, each of them an object."""
    sections = F.map_keys(F.try_variant_get(document, "$", "map<string,variant>"))
    wanted = F.array(*[F.lit(c) for c in HISTORY_COMPONENTS])
    # Only an object can be read as a map; the schema of a section would look at each of its samples.
    is_object = lambda c: F.try_variant_get(document, f"$['{c}']", "map<string,variant>").isNotNull()
    return [Rule("unreadable", sections.isNull(), F.lit("")),
            *[Rule(f"missing:{c}", ~F.array_contains(sections, c), F.lit("")) for c in HISTORY_COMPONENTS],
            Rule("unexpected", F.size(F.array_except(sections, wanted)) > 0, F.lit("")),
            *[Rule(f"not an object:{c}", F.array_contains(sections, c) & ~is_object(c), F.lit("")) for c in HISTORY_COMPONENTS]]


def parse(spark: SparkSession, path: str) -> DataFrame:
    """(path, document VARIANT) of bundle files with one document a line; unreadable ones are null."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("document"))


def read(spark: SparkSession, path: str) -> readers.Ingested:
    """Sound documents, and those that are no bundle with the rules they break, from one pass over the files."""
    return readers.ingest(parse(spark, path).withColumn("__id", F.monotonically_increasing_id()), section_rules())


def split(documents: DataFrame) -> dict[str, DataFrame]:
    """One typed table a component: the request's fields, with ``bundle_id`` first. All come from one written table."""
    typed = documents.select(*[F.try_variant_get("document", f"$['{c}']", request_schema(c).simpleString()).alias(c) for c in HISTORY_COMPONENTS])
    held = materialise(typed, "sections")
    return {c: held.select(F.col(f"`{c}`.request_id").alias("bundle_id"), F.col(f"`{c}`.*")).drop("request_id") for c in HISTORY_COMPONENTS}
