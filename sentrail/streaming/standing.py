"""Standing queries over streams: a versioned set, fan-out with dead letters, stateful operators."""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sentrail.operators.folds import admit
from sentrail.session import ensure_checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"{name}-{uuid.uuid4().hex}")


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """A table's files as a stream; the schema is that of the table."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, mode: str = "append", name: str = "drain") -> DataFrame:
    """Run a stream over what is there now and return its result as a table (in complete mode the last state)."""
    spark = stream.sparkSession
    out = folder(spark, name)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    # An empty first file gives the table its columns even if no batch writes.
    spark.createDataFrame([], stream.schema).write.parquet(out)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", folder(spark, name)).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def fan_out(subscribers: dict[str, tuple], dead_letters: Callable[[DataFrame, str, str], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each subscriber gets the rows of its predicate; one that fails gets its rows set aside.

    subscribers: name -> (predicate, sink) or (predicate, sink, priority); high priorities come first, equal
    ones (and those without, which have 0) in the order given.
    """
    ordered = sorted(subscribers.items(), key=lambda kv: -(kv[1][2] if len(kv[1]) > 2 else 0))

    def publish(batch: DataFrame, _: int) -> None:
        batch.persist()
        for name, (predicate, sink, *_rest) in ordered:
            own = batch.filter(F.expr(predicate))
            try:
                sink(own)
            except Exception as e:  # noqa: BLE001 - a subscriber's failure must not stop the others
                dead_letters(own, name, repr(e))
        batch.unpersist()

    return publish


class StandingQueries:
    """A versioned set of named streams; set() starts what is new or changed and stops what is gone."""

    def __init__(self) -> None:
        self.version, self._running = 0, {}

    def set(self, queries: dict[str, tuple[str, Callable[[], object]]]) -> list[str]:
        """queries: name -> (definition, start). Returns the names that were (re)started."""
        wanted = {n: hashlib.sha256(text.encode()).hexdigest() for n, (text, _) in queries.items()}
        if wanted == {n: h for n, (h, _) in self._running.items()}:
            return []
        self.version += 1
        started = []
        for name in [n for n in self._running if wanted.get(n) != self._running[n][0]]:
            self._running.pop(name)[1].stop()
        for name, (_, start) in queries.items():
            if name not in self._running:
                self._running[name] = (wanted[name], start())
                started.append(name)
        return started

    def stop(self) -> None:
        for _, query in self._running.values():
            query.stop()
        self._running = {}


def windows(stream: DataFrame, ts: str, kind: str, width: str, late: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts per tumbling, sliding or session window; rows later than `late` are dropped."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    w = F.session_window("_t", width) if kind == "session" else F.window("_t", width, slide or width)
    return timed.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_deliveries(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """One row per key among deliveries at most `late` apart."""
    return stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")


def admitted_stream(alerts: DataFrame, key: str, ts: str, row_id: str, limit: int = 5, seconds: float = 60.0) -> DataFrame:
    """The admission fold of operators.folds as a stateful stream: key's state is the times let through."""
    kind = dict(alerts.dtypes)
    timed = alerts.select(F.col(key).alias("k"), F.col(row_id).alias("id"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("now")).filter("k IS NOT NULL AND now IS NOT NULL")

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["now", "id"])
        let = [admit(times, now, limit, seconds) for now in rows["now"]]
        state.update((list(times),))
        yield pd.DataFrame({"id": rows["id"], "admitted": let})

    return timed.groupBy("k").applyInPandasWithState(step, f"id {kind[row_id]}, admitted boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout).withColumnRenamed("id", row_id)


def fifo_stream(stream: DataFrame, key: str, ts: str, row_id: str, is_trigger: str, is_history: str, max_rows: int, max_age_s: int) -> DataFrame:
    """row_id, recent: trigger rows with the last max_rows history rows of their key no older than max_age_s.

    A key's state is those rows alone, so it is bounded. Rows are taken in time's order within a batch; null
    keys and times are dropped.
    """
    kind = dict(stream.dtypes)[row_id]
    rows = stream.select(F.col(key).alias("k"), F.col(row_id).alias("id"), F.unix_seconds(F.col(ts).cast("timestamp")).alias("s"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.coalesce(F.expr(is_trigger), F.lit(False)).alias("asks"), F.coalesce(F.expr(is_history), F.lit(False)).alias("stays")).filter("k IS NOT NULL AND s IS NOT NULL AND (asks OR stays)")

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(zip(*state.get), max_rows) if state.exists else deque(maxlen=max_rows)
        out = []
        # A batch of a key may be large: its rows are sorted as arrays, and only the state is looped over.
        pdf = pd.concat(list(batches)).sort_values(["us", "id"])
        for own, s, asks, stays in zip(pdf["id"].tolist(), pdf["s"].tolist(), pdf["asks"].tolist(), pdf["stays"].tolist()):
            if asks:
                out.append((own, [i for t, i in held if t >= s - max_age_s]))
            if stays:
                held.append((s, own))
        state.update(([t for t, _ in held], [i for _, i in held]))
        yield pd.DataFrame(out, columns=["id", "recent"])

    return rows.groupBy("k").applyInPandasWithState(step, f"id {kind}, recent array<{kind}>", f"times array<long>, ids array<{kind}>", "append", GroupStateTimeout.NoTimeout).withColumnRenamed("id", row_id)


def in_parts(sink: Callable[[DataFrame], None], max_rows: int = 10_000, max_bytes: int = 5_000_000) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands a batch on in parts of about max_rows rows and max_bytes as JSON; empty ones are not sent."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        n, size = batch.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
        parts = max(-(-n // max_rows), -(-size // max_bytes))
        for i in range(parts):
            part = batch if parts == 1 else batch.filter(F.pmod(F.xxhash64(F.to_json(F.struct("*"))), F.lit(parts)) == i)
            if parts == 1 or part.limit(1).count():
                sink(part)
        batch.unpersist()

    return write


def interleave(*streams: DataFrame) -> DataFrame:
    """Several streams as one; columns that one lacks are null."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def late_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, seconds: int, late: str) -> DataFrame:
    """Left rows with right rows of the same key at most `seconds` away, as they come.

    A left row that no right row meets is given out with nulls once the watermark has passed it, so what
    is remembered stays bounded. right's columns get the prefix r_.
    """
    a = left.withColumn("_t", F.col(left_ts).cast("timestamp")).withWatermark("_t", late)
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.col(right_ts).cast("timestamp").alias("_u")).withWatermark("_u", late)
    near = (F.col("_u") >= F.col("_t") - F.expr(f"INTERVAL {seconds} SECONDS")) & (F.col("_u") <= F.col("_t") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return a.join(b, (F.col(key) == F.col(f"r_{key}")) & near, "left_outer").drop("_t", "_u")


def ticks(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A clock: rows of time, unix and unix_nano."""
    r = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return r.select(F.col("timestamp").alias("time"), F.unix_seconds("timestamp").alias("unix"), (F.unix_micros("timestamp") * 1000).alias("unix_nano"))


class StallWatch(StreamingQueryListener):
    """Notes when each stream last moved; stalled(now, limit) names those that stand still longer."""

    def __init__(self, clock: Callable[[], float] = time.time) -> None:
        self._clock, self.moved, self.ended = clock, {}, {}

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        self.moved[event.name or str(event.id)] = self._clock()

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            self.moved[p.name or str(p.id)] = self._clock()

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        """Nothing to read is no progress."""

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception

    def stalled(self, limit_s: float) -> list[str]:
        now = self._clock()
        return sorted(n for n, t in self.moved.items() if now - t > limit_s)
