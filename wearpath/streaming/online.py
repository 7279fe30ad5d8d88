"""Online counterparts of the batch operators on Structured Streaming.

`in_order` is what the others stand on: rows of a unit wait in its state until the watermark has passed them, and then
go, sorted by their whole order tuple, through a step that keeps a few numbers (a short buffer, running sums). What
cannot be placed any more is not dropped but comes out with a status:

* ``accepted``: in its place; the step's columns are filled;
* ``repeated``: a second row with the same order tuple (or, where a step remembers keys, the same key);
* ``late``: before what the unit has released already;
* ``untimed``: without an order value.

So accepted and other rows together are the input, and as long as rows arrive within ``hold`` of each other's time, results
depend neither on the number of files nor on their order.

Spark drops rows behind the watermark before a stateful operator sees them. `timed` keeps them: a row's time
enters the watermark through a copy that carries nothing else, and the row itself has no time in Spark's eyes.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import quality
from ..session import shared_folder

ACCEPTED, REPEATED, LATE, UNTIMED = "accepted", "repeated", "late", "untimed"
#: The time of the row that ends a replay; later than any event.
CLOSING = "9999-01-01 00:00:00"


# -- sources and sinks ------------------------------------------------------------------------
def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 16) -> DataFrame:
    """A table's file(s) as a stream, in the order in which files arrived."""
    path = os.path.join(folder, f"{name}.parquet")
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)  # a folder of part files
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def replay(table: DataFrame, event_time: str, slices: int = 4, files_per_trigger: int | None = None) -> tuple[DataFrame, str]:
    """A stored table as a stream that arrives roughly by time, and how long rows must be held to be in order.

    The table is written in ``slices`` of equal time, one after the other, so that files arrive in that order whatever
    the table's own files are; inside a slice they come in any order. The last file holds one row at `CLOSING`: it
    moves the watermark past everything, which releases what still waits. A trigger takes a slice's share of the files unless told
    otherwise, so that the rows that wait are written a few times, however many files there are.
    """
    spark = table.sparkSession
    table = table.withColumn(event_time, F.col(event_time).cast("timestamp"))
    path = shared_folder(spark, "arrivals")
    low, high = table.agg(F.min(F.unix_micros(event_time)), F.max(F.unix_micros(event_time))).first()
    low, high = (0, 0) if low is None else (low, high)
    width = (high - low) // slices + 1
    at = F.unix_micros(event_time)
    for k in range(slices):
        mine = (at >= low + k * width) & (at < low + (k + 1) * width)
        table.filter(mine | at.isNull() if k == 0 else mine).write.mode("append").parquet(path)
    end = spark.range(1).select(*[(F.lit(CLOSING) if c == event_time else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    end.write.mode("append").parquet(path)
    if files_per_trigger is None:
        files_per_trigger = max(16, -(-len(spark.read.schema(table.schema).parquet(path).inputFiles()) // slices))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream, f"{-(-width // 1_000_000)} seconds"


def timed(stream: DataFrame, event_time: str, hold: str) -> DataFrame:
    """The stream's rows, none of them dropped for being late, under a watermark of their times.

    Adds ``at`` (microseconds) and ``clock`` (null; the column that carries the watermark for `in_order`).
    """
    time = F.col(event_time)
    only_time, only_row = F.array(F.lit(True)), F.array(F.lit(False))
    ticks = F.when(time.isNull(), only_row).when(time >= F.lit(CLOSING).cast("timestamp"), only_time).otherwise(F.concat(only_time, only_row))
    both = stream.withColumns({"at": F.unix_micros(time), "__tick": F.explode(ticks)})
    both = both.withColumn("clock", F.when(F.col("__tick"), time)).withWatermark("clock", hold)
    # The filter names the clock alone, so it stays above the watermark.
    return both.filter("clock IS NULL").drop("__tick")


def run_to_end(stream: DataFrame, purpose: str, mode: str = "append", partition_by: Sequence[str] = ()) -> DataFrame:
    """Process everything available into a Parquet sink and read it back."""
    spark = stream.sparkSession
    base = shared_folder(spark, purpose)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{base}/offsets")
    query = writer.partitionBy(*partition_by).trigger(availableNow=True).start(f"{base}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


# -- rows of a unit in order ------------------------------------------------------------------
# Rows of many units, each unit's together and in order; the place of each unit's first row; each unit's state (or none).
# Returns the rows with the new columns and each unit's new state.
Step = Callable[[pd.DataFrame, np.ndarray, list[tuple | None]], tuple[pd.DataFrame, list[tuple]]]
#: Keys of the state, unless the session setting ``spark.wearpath.streamShards`` says otherwise.
SHARDS = 256


def _packed(rows: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def in_order(rows: DataFrame, unit: str, order: Sequence[str], output: list[T.StructField], state_ddl: str, step: Step, shards: int | None = None) -> DataFrame:
    """Feed each unit's rows to ``step(rows, starts, states)`` in order; a status says what became of each row.

    ``order`` begins with the row's time in microseconds where the rows have a ``clock`` (see `timed`); rows are then held
    until the watermark passes them. Without a clock they go at once, in the order of their batch, and what comes
    before an earlier batch is late. ``step`` gets accepted rows and returns them with the ``output`` columns; it may set ``status``
    itself. Units are dealt to ``shards`` by a hash, so that a call serves many of them. A shard's state holds each unit's last
    order tuple and the step's own state, and the rows that wait.
    """
    order, held_back = list(order), "clock" in rows.columns
    if shards is None:
        shards = int(rows.sparkSession.conf.get("spark.wearpath.streamShards", str(SHARDS)))
    columns = [c for c in rows.columns if c != "clock"]
    added = [f.name for f in output]
    schema = T.StructType([rows.schema[unit], *[rows.schema[c] for c in columns if c != unit], T.StructField("status", T.StringType()), *output])
    names = schema.fieldNames()
    carried = [unit, *[c for c in columns if c != unit]]
    own = T.StructType.fromDDL(state_ddl)
    many = lambda name, kind: T.StructField(name, T.ArrayType(kind))
    state_schema = T.StructType([
        many("units", rows.schema[unit].dataType), *[many(f"last_{c}", rows.schema[c].dataType) for c in order],
        *[many(f.name, f.dataType) for f in own.fields], T.StructField("waiting", T.BinaryType())])
    whole = {c for c in columns if isinstance(rows.schema[c].dataType, T.IntegralType)}

    def plain(values: pd.Series, c: str) -> list:
        # A whole number next to a null comes as a float.
        return [None if pd.isna(v) else int(v) if c in whole else v for v in values.tolist()]

    def advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, mine, parts = {}, {}, []
        if state.exists:
            units, *lists, packed = tuple(state.get)
            last = dict(zip(units, zip(*lists[:len(order)])))
            mine = dict(zip(units, zip(*lists[len(order):]))) if len(own) else {}
            if packed:
                parts.append(pa.ipc.open_stream(bytes(packed)).read_pandas())
        if not state.hasTimedOut:
            parts += [b[carried] for b in batches if len(b)]
        if not parts:
            return
        # Rows without a unit have a shard of their own: units sort.
        fresh = pd.concat(parts, ignore_index=True).sort_values([unit, *order], kind="stable", ignore_index=True)
        same_unit = (fresh[unit] == fresh[unit].shift()) | (fresh[unit].isna() & (np.arange(len(fresh)) > 0))
        number = np.cumsum(~same_unit.to_numpy(bool)) - 1
        labels = np.array([*plain(fresh.loc[~same_unit, unit], unit), None], dtype=object)[:-1]
        status = np.full(len(fresh), ACCEPTED, dtype=object)
        status[fresh.duplicated([unit, *order], keep="first").to_numpy()] = REPEATED
        seen = np.array([label in last for label in labels], dtype=bool)
        if seen.any():
            rows_seen = np.flatnonzero(seen[number])
            told, which = fresh.loc[rows_seen], (np.cumsum(seen) - 1)[number[rows_seen]]
            released = list(zip(*[last[label] for label in labels[seen]]))
            before, same = np.zeros(len(told), dtype=bool), np.ones(len(told), dtype=bool)
            for c, values in zip(order, released):
                values = pd.Series(values, index=range(len(values))).take(which).set_axis(told.index)
                before |= same & (told[c] < values).to_numpy(bool)
                same &= (told[c] == values).to_numpy(bool)
            status[rows_seen[before]], status[rows_seen[same]] = LATE, REPEATED
        status[fresh[order].isna().any(axis=1).to_numpy()] = UNTIMED
        limit = state.getCurrentWatermarkMs() * 1000 if held_back else None
        wait = (status == ACCEPTED) & (fresh[order[0]] > limit).to_numpy() if held_back else np.zeros(len(fresh), dtype=bool)
        go = (status == ACCEPTED) & ~wait
        good = fresh.loc[go].reset_index(drop=True)
        if len(good):
            good = good.infer_objects()
            starts = np.flatnonzero(np.diff(number[go], prepend=-1))
            met, ends = labels[number[go][starts]], np.append(starts[1:], len(good)) - 1
            built, states = step(good, starts, [mine.get(label) for label in met])
            last.update(zip(met, zip(*[plain(good[c].iloc[ends], c) for c in order])))
            mine.update(zip(met, states))
            yield (built if "status" in built else built.assign(status=ACCEPTED))[names]
        rest = status != ACCEPTED
        if rest.any():
            yield fresh.loc[rest].assign(status=status[rest], **{c: None for c in added})[names]
        later = fresh.loc[wait]
        state.update((list(last), *[[held[i] for held in last.values()] for i in range(len(order))],
                      *[[mine[label][i] for label in last] for i in range(len(own))], _packed(later) if len(later) else None))
        if len(later):
            state.setTimeoutTimestamp(int(later[order[0]].min()) // 1000 + 1)

    timeout = GroupStateTimeout.EventTimeTimeout if held_back else GroupStateTimeout.NoTimeout
    shard = F.when(F.col(unit).isNull(), -1).otherwise(F.pmod(F.xxhash64(unit), F.lit(shards)).cast("int"))
    return rows.withColumn("__shard", shard).groupBy("__shard").applyInPandasWithState(advance, schema, state_schema, "append", timeout)


def _trailing_moments(x: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the finite values among each row's last ``window``; ``place``: rows before it in its unit."""
    def over(values):
        total = np.zeros(len(x))
        for back in range(min(window, len(x))):
            total[back:] += np.where(place[back:] >= back, values[:len(x) - back], 0.0)
        return total

    there = np.isfinite(x)
    filled = np.where(there, x, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        n = over(there.astype(float))
        mean = over(filled) / n
        spread = np.zeros(len(x))
        for back in range(min(window, len(x))):
            use = (place[back:] >= back) & there[:len(x) - back]
            spread[back:] += np.where(use, (filled[:len(x) - back] - mean[back:]) ** 2, 0.0)
        return mean, np.sqrt(spread / n)


def causal_features(rows: DataFrame, unit: str, order: Sequence[str], value: str, window: int = 5, span: int = 5, baseline: int = 10) -> DataFrame:
    """First difference, trailing mean and deviation, recursive mean and growing baseline of a stream."""
    alpha = 2.0 / (span + 1)
    names = (f"{value}_delta", f"{value}_mean_{window}", f"{value}_std_{window}", f"ewm{span}", f"{value}_baseline")
    output = [T.StructField("cycle", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]]
    reach = max(window - 1, 1)

    def step(good, starts, held):
        x = good[value].to_numpy(float)
        cycles, smoothed, base, states, joined = [], [], [], [], []
        for b, e, state in zip(starts, np.append(starts[1:], len(x)), held):
            count, level, head_sum, head_n, buffer = state or (0, None, 0.0, 0, [])
            mine = x[b:e].tolist()
            for v in mine:  # a few additions per new record
                count += 1
                level = v if level is None else alpha * v + (1 - alpha) * level
                if count <= baseline:
                    head_sum, head_n = head_sum + v, head_n + 1
                cycles.append(count)
                smoothed.append(level)
                base.append(head_sum / head_n)
            joined += [*buffer, *mine]
            states.append((count, level, head_sum, head_n, [*buffer, *mine][-reach:]))
        # What a unit keeps of earlier rows stands before its new ones.
        kept = np.array([len(state[4]) if state else 0 for state in held])
        sizes = np.diff(np.append(starts, len(x))) + kept
        place = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        new = place >= np.repeat(kept, sizes)
        joined = np.array(joined, dtype=float)
        mean, spread = _trailing_moments(joined, place, window)
        delta = np.where(place > 0, np.diff(joined, prepend=0.0), 0.0)
        columns = (cycles, np.where(np.isnan(delta), 0.0, delta)[new], mean[new], spread[new], smoothed, base)
        return good.assign(**dict(zip(("cycle", *names), columns))), states

    return in_order(rows, unit, order, output, "seen long, level double, head_sum double, head_n long, buffer array<double>", step)


def persistence_alerts(rows: DataFrame, unit: str, order: Sequence[str], vote: str, window: int = 5, required: int = 3, position: str | None = None) -> DataFrame:
    """Alert when enough of the last votes are 1; a gap in the positions (where rows have one) clears the votes."""
    output = [T.StructField("cycle", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("alert", T.IntegerType())]

    def step(good, starts, held):
        ballots = good[vote].to_numpy(int).tolist()
        positions = good[position].tolist() if position else None
        cycles, segments, alerts, states = [], [], [], []
        for b, e, state in zip(starts.tolist(), [*starts[1:].tolist(), len(good)], held):
            count, segment, previous, votes = state or (0, 0, None, [])
            recent = deque(votes, window)
            for i in range(b, e):
                count += 1
                at = positions[i] if position else count
                if previous is not None and at != previous + 1:
                    segment += 1
                    recent.clear()
                previous = at
                recent.append(ballots[i])
                cycles.append(count)
                segments.append(segment)
                alerts.append(sum(recent) >= required)
            states.append((count, segment, int(previous), list(recent)[-(window - 1):] if window > 1 else []))
        return good.assign(cycle=cycles, segment=segments, alert=np.array(alerts, dtype="int32")), states

    return in_order(rows, unit, order, output, "seen long, segment long, previous long, votes array<int>", step)


def first_of_key(rows: DataFrame, key: str, memory_seconds: int, buckets: int = 64) -> DataFrame:
    """The stream with a status: the first row of each key, in time order, is accepted, others are repeated.

    Keys are remembered in hash buckets for ``memory_seconds`` of event time after they were last met, so state is
    bounded by the keys of that time and a bucket holds its share of them.
    """
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    memory = memory_seconds * 1_000_000

    def step(good, starts, held):
        status, states = [], []
        keys, times = good[key].tolist(), good["at"].tolist()
        for b, e, state in zip(starts.tolist(), [*starts[1:].tolist(), len(good)], held):
            known = dict(zip(*state)) if state else {}
            for k, at in zip(keys[b:e], times[b:e]):
                status.append(REPEATED if k in known and at - known[k] <= memory else ACCEPTED)
                known[k] = at
            now = int(times[e - 1])
            known = {k: at for k, at in known.items() if now - at <= memory}
            states.append((list(known), list(known.values())))
        return good.assign(status=status), states

    kind = rows.schema[key].dataType.simpleString()
    return in_order(dealt, "__bucket", ["at", key], [], f"keys array<{kind}>, seen array<long>", step).drop("__bucket")


def quality_split(rows: DataFrame, rules: Callable[[], list[quality.Rule]], accepted: str, rejected: str, offsets: str):
    """Rows with a status (see `first_of_key`) to two tables: sound ones, and the others with the names of what they break.

    A row that was repeated, late or untimed is rejected under that name. Batches are written under their number, so a
    replayed batch overwrites itself. Returns the started query.
    """
    def write(batch: DataFrame, number: int) -> None:
        broken = F.array_compact(F.array(
            F.when(F.col("status") != ACCEPTED, F.col("status")), *[F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.name)) for r in rules()]))
        marked = batch.withColumn("broken_rules", broken).drop("status", "at")
        marked.filter(F.size("broken_rules") == 0).drop("broken_rules").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        marked.filter(F.size("broken_rules") > 0).write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", offsets).trigger(availableNow=True).start()


# -- change of inputs against a baseline --------------------------------------------------------
def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """The number of edges at or below a value; null for null and NaN."""
    above = sum((F.when(value >= float(e), 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(value.isNotNull() & ~F.isnan(value), above)


def support_drift(rows: DataFrame, regime: str, value: str, low: float, high: float, edges: Sequence[float], window: str = "1 day") -> DataFrame:
    """Per event-time window, regime and histogram bin: rows, sums and rows outside the fitted range.

    ``rows`` carry a watermark on ``clock`` with the event times in it (see `clocked`). A window's state is one short row
    per bin; counts and sums of parts add up, so windows of any size come from partial aggregates.
    """
    v = F.col(value)
    outside = ((v < low) | (v > high)).cast("long")
    return rows.groupBy(F.window("clock", window), regime, bin_of(v, edges).alias("bin")).agg(
        F.count("*").alias("rows"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.sum(outside).alias("outside")).select(
        F.col("window.start").alias("window_start"), regime, "bin", "rows", "total", "squares", "outside")


def clocked(stream: DataFrame, event_time: str, hold: str) -> DataFrame:
    """The stream under a plain watermark, for windows: ``clock`` is the event time; the closing row only moves the watermark."""
    marked = stream.withColumn("clock", F.col(event_time)).withWatermark("clock", hold)
    return marked.filter(F.col("clock") < F.lit(CLOSING).cast("timestamp"))


def drift_report(bins: DataFrame, baseline: DataFrame, regime: str) -> DataFrame:
    """Windows against the stored baseline of their regime: counts, both means, and two statistics with their uncertainty.

    ``baseline`` has the columns of `support_drift` without the window. ``shift`` is the difference of means and
    ``shift_error`` its standard error; ``statistic`` is the two-sample chi-square of the histograms, with ``freedom``
    (occupied bins - 1) and ``excess``, its distance from the mean of that distribution in standard deviations.
    """
    def summary(df, *keys):
        n, total, squares = F.sum("rows"), F.sum("total"), F.sum("squares")
        return df.groupBy(*keys).agg(n.alias("rows"), (total / n).alias("mean"), ((squares - total * total / n) / n).alias("variance"), (F.sum("outside") / n).alias("outside_rate"))

    base = summary(baseline, regime).select(regime, *[F.col(c).alias(f"base_{c}") for c in ("rows", "mean", "variance", "outside_rate")])
    windows = summary(bins, "window_start", regime).join(base, regime)
    grid = windows.select("window_start", regime, "rows", "base_rows").join(
        baseline.select(regime, "bin").unionByName(bins.select(regime, "bin")).distinct(), regime)
    mine = bins.select("window_start", regime, "bin", F.col("rows").alias("a"))
    theirs = baseline.select(regime, "bin", F.col("rows").alias("b"))
    met = grid.join(mine, ["window_start", regime, "bin"], "left").join(theirs, [regime, "bin"], "left").fillna(0, ["a", "b"]).filter("a + b > 0")
    gap = F.sqrt(F.col("base_rows") / F.col("rows")) * F.col("a") - F.sqrt(F.col("rows") / F.col("base_rows")) * F.col("b")
    chi = met.groupBy("window_start", regime).agg(F.sum(gap * gap / (F.col("a") + F.col("b"))).alias("statistic"), (F.count("*") - 1).alias("freedom"))
    return windows.join(chi, ["window_start", regime]).withColumns({
        "shift": F.col("mean") - F.col("base_mean"), "shift_error": F.sqrt(F.col("variance") / F.col("rows") + F.col("base_variance") / F.col("base_rows")),
        "excess": F.when(F.col("freedom") > 0, (F.col("statistic") - F.col("freedom")) / F.sqrt(2 * F.col("freedom")))})


# -- predictions and their outcomes --------------------------------------------------------------
def with_outcomes(predictions: DataFrame, outcomes: DataFrame, on: Sequence[str], made: str, reviewed: str, within: str) -> DataFrame:
    """Two watermarked streams joined: each prediction with its review, if one comes in time.

    A review counts from the prediction's time until ``within`` later; the bound lets state go. ``outcome`` is ``reviewed``, or
    ``unreviewed`` for a prediction whose time has run out, or ``unmatched`` for a review without a
    prediction it could count for (too late, too early, or of an unknown key).
    """
    p, o = predictions.alias("p"), outcomes.alias("o")
    same = [F.col(f"p.{c}") == F.col(f"o.{c}") for c in on]
    time = (F.col(f"o.{reviewed}") >= F.col(f"p.{made}")) & (F.col(f"o.{reviewed}") <= F.col(f"p.{made}") + F.expr(f"INTERVAL {within}"))
    condition = time
    for c in same:
        condition = condition & c
    joined = p.join(o, condition, "full_outer")
    rest = [F.col(f"p.{c}") for c in predictions.columns if c not in on] + [F.col(f"o.{c}") for c in outcomes.columns if c not in on]
    outcome = F.when(F.col(f"p.{made}").isNull(), "unmatched").when(F.col(f"o.{reviewed}").isNull(), "unreviewed").otherwise("reviewed")
    return joined.select(*[F.coalesce(F.col(f"p.{c}"), F.col(f"o.{c}")).alias(c) for c in on], *rest, outcome.alias("outcome"))
