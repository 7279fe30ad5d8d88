"""Column helpers for the text, date, array and JSON conventions of the input files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number syntax, texts that mean "missing", hexadecimal digest, measurement file name.
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
MISSING_TEXTS = ("", "[]")
SHA256_HEX = r"^[0-9a-fA-F]{64}$"
MEASUREMENT_FILE = r"^[^/\\]+\.[cC][sS][vV]$"


def numbers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda v: v.try_cast("double"))


def timestamp_from_vector(text: Column) -> Column:
    """Six numbers (y m d h min s.fraction) to a timestamp; null unless exactly six are present."""
    v = numbers_in(text)
    part = lambda i: F.get(v, i).cast("int")
    valid = ((F.size(v) == 6) & part(1).between(1, 12) & part(2).between(1, 31)
             & part(3).between(0, 23) & part(4).between(0, 59))
    minute = F.format_string("%04d-%02d-%02d %02d:%02d:00", part(0), part(1), part(2), part(3), part(4))
    base = F.when(valid, minute).try_cast("timestamp_ntz")
    return base + F.make_dt_interval(secs=F.get(v, 5).cast("decimal(18,6)"))


def missing_to_null(text: Column, missing: Sequence[str] = MISSING_TEXTS) -> Column:
    return F.when(~F.trim(text).isin(*missing), text)


def complex_number(text: Column) -> Column:
    """``(a+bj)`` / ``a`` / ``bj`` to struct<re, im>; null for missing or malformed texts."""
    bare = F.regexp_replace(F.trim(text), r"^\((.*)\)$", "$1")
    real_only = bare.rlike(f"^{NUMBER}$")
    imaginary_only = bare.rlike(f"^{NUMBER}[jJ]$")
    both = bare.rlike(f"^{NUMBER}[-+](?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:[eE][-+]?\\d+)?[jJ]$")
    first = F.regexp_extract(bare, f"^({NUMBER})", 1).try_cast("double")
    last = F.regexp_extract(bare, r"([-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?)[jJ]$", 1).try_cast("double")
    return F.when(real_only, F.struct(first.alias("re"), F.lit(0.0).alias("im"))).when(
        imaginary_only, F.struct(F.lit(0.0).alias("re"), last.alias("im"))).when(
        both, F.struct(first.alias("re"), last.alias("im")))


def magnitude(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def safe_file_name(name: Column) -> Column:
    return name.rlike(MEASUREMENT_FILE)


def normalized(text: Column) -> Column:
    """Byte-order mark off, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, "^\uFEFF", "")))


def boolean_word(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)


def is_sha256(text: Column) -> Column:
    return text.rlike(SHA256_HEX)


def is_web_address(text: Column) -> Column:
    return F.lower(text).startswith("https://") | F.lower(text).startswith("http://")


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds where given; a missing side is left open."""
    if low is not None:
        value = F.greatest(value, F.lit(low))
    return value if high is None else F.least(value, F.lit(high))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def array_std(values: Column) -> Column:
    """Population deviation about the array's mean."""
    mean = array_mean(values)
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(values))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def quadratic_form(values: Sequence[Column], matrix: Sequence[Sequence[float]]) -> Column:
    """x' P x: each value times its row's weighted sum, zero weights left out."""
    rows = []
    for row in matrix:
        terms = [values[j] * F.lit(float(weight)) for j, weight in enumerate(row) if weight]
        rows.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return dot(F.array(*values), F.array(*rows))


def arg_max(names: Sequence[str], values: Column) -> Column:
    """Name of the largest entry, the first on ties."""
    return F.get(F.array(*[F.lit(n) for n in names]), (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def soft_gates(distances: Column, width: float) -> Column:
    """Softmax of negative squared distances, shifted by the largest exponent."""
    scores = F.transform(distances, lambda d: -d * d / (2 * width * width))
    shifted = lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    shares = lambda raised: let(F.aggregate(raised, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(raised, lambda v: v / total))
    return let(scores, lambda s: let(shifted(s), shares))


def wall_micros(moment: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's time zone."""
    days = F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    clock = F.hour(moment).cast("long") * 3600 + F.minute(moment) * 60
    return (days * 86400 + clock) * 1000000 + (F.date_part(F.lit("SECOND"), moment) * 1000000).cast("long")


def utc_seconds(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def notes(*pairs: tuple[Column, str]) -> Column:
    """Texts whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(text)) for condition, text in pairs]))


def name_of_each(flags: Iterable[tuple[str, Column]]) -> Column:
    return notes(*[(flag, name) for name, flag in flags])
