"""Continuous forms of the upsert and the counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from forgelake.functions.identity import long_hash, short_hash, with_fingerprint
from forgelake.operators.upsert import classify, latest, near_rows, written


# Micro-batches after which the log is folded into a base.
COMPACT_EVERY = 16


class WriteLog:
    """The rows an upsert stream has written, one folder per micro-batch.

    A micro-batch replayed after a failure replaces its own folder, so each takes effect once. The
    table as of now is the last written row per key. :meth:`compact` folds finished batches into a
    base, so that reading stays proportional to the table and not to its history.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str]):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.keys, self.order = list(keys), list(order)

    def _read(self, part: str, *extra: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, *[T.StructField(e, T.LongType()) for e in extra]])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{part}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def rows(self, before: int | None = None) -> DataFrame:
        """Written rows needed to tell the state, optionally that before a batch."""
        log, base = self._read("log", "batch_id"), self._read("base", "batch_id", "through")
        if before is not None:
            log, base = log.filter(F.col("batch_id") < before), base.filter(F.col("through") < before)
        newest = base.agg(F.max("through")).first()[0]
        if newest is None:
            return log
        return base.filter(F.col("through") == newest).drop("through").unionByName(log.filter(F.col("batch_id") > newest))

    def _last(self, rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in self.keys]
        # The fingerprint moves by its bytes.
        last = F.max_by(F.struct(*values), F.struct("batch_id", *self.order))
        found = rows.withColumn("hash", short_hash("hash")).groupBy(*self.keys).agg(last.alias("_v"))
        return found.select(*self.keys, "_v.*").withColumn("hash", long_hash("hash"))

    def state(self, before: int | None = None) -> DataFrame:
        """Last written row per key, optionally as it was before a batch."""
        return self._last(self.rows(before)).drop("batch_id")

    def stored_for(self, batch: DataFrame, before: int) -> DataFrame:
        """The state before a batch, for the keys of that batch only."""
        rows = self.rows(before).join(batch.select(*self.keys).distinct(), self.keys, "left_semi")
        return self._last(rows).drop("batch_id")

    def history_for(self, batch: DataFrame, before: int) -> DataFrame:
        """Key, fingerprint, order and ``batch_id`` of the rows written before a batch that may have one of its keys: of
        each key all rows or none, so the last is its state."""
        rows = self.rows(before).select(*dict.fromkeys([*self.keys, "hash", *self.order]), "batch_id")
        return near_rows(rows, batch, self.keys)[0]

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self.schema.names).write.option("compression", "zstd").mode("overwrite").parquet(f"{self.root}/log/batch_id={batch_id}")

    def compact(self, through: int) -> None:
        """Write the state after batch ``through`` as a base; older files may then be removed."""
        self._last(self.rows(through + 1)).write.option("compression", "zstd").mode("overwrite").parquet(f"{self.root}/base/through={through}")


def upsert_stream(
    source: DataFrame,
    log: WriteLog,
    checkpoint: str,
    identity: tuple[str, ...],
    *,
    stamp: Callable[[], Column] | None = None,
    compact_every: int | None = COMPACT_EVERY,
    last_wins: bool = False,
    persist: bool = False,
    chunk_rows: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Start a deduplicating upsert of a stream into ``log``; rows keep their arrival order.

    ``stamp`` gives ``updated_at`` of written rows. Each micro-batch compares with the stored rows
    of its own keys only. With ``last_wins`` the last row of a key is written whatever is stored, as
    contacts are saved; nothing stored is then read. Several passes read the batch, which files serve well column by column;
    ``persist`` keeps the batch of a source, or of transformations, that cost more to repeat.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist() if persist else batch
        try:
            if last_wins:
                fresh = latest(with_fingerprint(rows, identity), log.keys, log.order)
            else:
                stored = log.history_for(rows, batch_id)
                found = classify(rows, log.keys, log.order, identity, stored, stored_order=["batch_id"], chunk_rows=chunk_rows)
                fresh = written(found)
            if stamp is not None:
                fresh = fresh.withColumn("updated_at", stamp())
            log.write(fresh, batch_id)
        finally:
            if persist:
                rows.unpersist()
        if compact_every and (batch_id + 1) % compact_every == 0:
            log.compact(batch_id)

    trigger = trigger or {"availableNow": True}
    return (
        source.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def live_counts(streams: dict[str, DataFrame]) -> DataFrame:
    """Streaming row count per table, for output mode ``complete`` or ``update``."""
    tagged = None
    for name, rows in streams.items():
        part = rows.select(F.lit(name).alias("entity"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("entity").agg(F.count("*").alias("n"))


def newest_counts(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """The counts of the newest batch under ``root``, 0 for tables of ``names`` without a row so far."""
    counts = spark.read.schema("entity string, n bigint, batch_id bigint").parquet(root)
    newest = counts.agg(F.max("batch_id")).first()[0]
    found = counts.filter(F.col("batch_id") == newest).select("entity", "n")
    every = spark.range(1).select(F.explode(F.array(*(F.lit(n) for n in names))).alias("entity"))
    return every.join(found, "entity", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def first_sightings(
    stream: DataFrame, keys: Sequence[str], *, event_time: str | None = None, delay: str | None = None
) -> DataFrame:
    """First sighting of each (key, fingerprint); with a watermark the state stays bounded.

    Unlike the upsert, a fingerprint that comes back after a different one is dropped.
    """
    columns = [*keys, "hash"]
    if event_time is None:
        return stream.dropDuplicates(columns)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(columns)
