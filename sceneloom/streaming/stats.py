"""Running statistics of training as structured streams.

Append mode gives a window when the watermark has passed its end; the last
ones need a later row, so send a closing one or read in update mode. In
update mode a sink gets a row for each changed key and batch: the last batch
counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Take all there is and write each batch as Parquet with its ``batch_id``; in complete mode each replaces the one before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_prim_stats(views: DataFrame, every: str = "100 seconds", late: str = "0 seconds") -> DataFrame:
    """Statistics of each primitive over tumbling windows, from rows (ts, scene_id, prim_id, radius, grad_x, grad_y).

    One second of ``ts`` stands for one iteration.
    """
    length = F.sqrt(F.col("grad_x") * F.col("grad_x") + F.col("grad_y") * F.col("grad_y"))
    seen = views.filter("radius > 0").withWatermark("ts", late)
    return seen.groupBy(F.window("ts", every), "scene_id", "prim_id").agg(F.sum(length).alias("grad_sum"), F.count(F.lit(1)).alias("denom"), F.max("radius").alias("max_radius"))


def batch_prim_stats(views: DataFrame, every: int = 100) -> DataFrame:
    """The same of a whole table, by ``iteration``."""
    length = F.sqrt(F.col("grad_x") * F.col("grad_x") + F.col("grad_y") * F.col("grad_y"))
    window = F.floor(F.col("iteration") / every).alias("window")
    return views.filter("radius > 0").groupBy(window, "scene_id", "prim_id").agg(F.sum(length).alias("grad_sum"), F.count(F.lit(1)).alias("denom"), F.max("radius").alias("max_radius"))


class RunningMean(StatefulProcessor):
    """Running mean of one series, in order of (ts, event_id) whatever the order of arrival within the watermark's delay.

    Rows wait until the watermark has passed them; then they are applied in order
    and only the mean is kept. A series without rows for ``idle_ms`` of event time is forgotten.
    """

    def __init__(self, share: float, idle_ms: int):
        self.share, self.idle_ms = share, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mean = handle.getValueState("mean", "value double, n long, n_late long, ts long, event_id long")
        self.waiting = handle.getListState("waiting", "ts long, event_id long, loss double")

    def _after(self, value: float, losses: pd.Series) -> float:
        """A null loss leaves the mean as it is."""
        if not len(losses) or self.share >= 1:
            return float(losses.dropna().iloc[-1]) if losses.notna().any() else value
        return float(pd.concat([pd.Series([value]), losses.astype(float)]).ewm(alpha=self.share, adjust=False, ignore_na=True).mean().iloc[-1])

    def _advance(self, key: tuple, rows: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        """Take rows in and apply those that the watermark (ms) has passed. Times are in microseconds."""
        value, n, late, ts, event = self.mean.get() if self.mean.exists() else (0.0, 0, 0, -(1 << 62), 0)
        old = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["ts", "event_id", "loss"])
        # What stands at or before the last row that was applied came too late.
        before = (rows["ts"] < ts) | ((rows["ts"] == ts) & (rows["event_id"] <= event))
        late += int(before.sum())
        rows = pd.concat([x for x in (old, rows[~before]) if len(x)] or [old]).sort_values(["ts", "event_id"], kind="stable")
        passed = rows["ts"] < watermark * 1000
        done, rest = rows[passed], rows[~passed]
        if len(done):
            value, n, ts, event = self._after(value, done["loss"]), n + len(done), int(done["ts"].iloc[-1]), int(done["event_id"].iloc[-1])
        self.mean.update((value, n, late, ts, event))
        if len(rest):
            self.waiting.put([(int(t), int(e), None if pd.isna(x) else float(x)) for t, e, x in rest.itertuples(index=False)])
        else:
            self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = max(ts, int(rest["ts"].iloc[-1]) if len(rest) else ts)
        # To apply what waits; without any, to forget the series.
        self.handle.registerTimer((int(rest["ts"].iloc[0]) // 1000 + 1) if len(rest) else last // 1000 + self.idle_ms)
        yield pd.DataFrame({"series": [key[0]], "ema": [self._after(value, rest["loss"])], "n": [n + len(rest)], "n_late": [late], "n_waiting": [len(rest)]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, pd.concat([r[["ts", "event_id", "loss"]] for r in rows]), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            yield from self._advance(key, pd.DataFrame({"ts": [], "event_id": [], "loss": []}).astype({"ts": "int64", "event_id": "int64"}), timerValues.getCurrentWatermarkInMs())
        else:
            self.mean.clear()


def stream_ema_loss(losses: DataFrame, share: float = 0.4, late: str = "0 seconds", idle_ms: int = 86_400_000) -> DataFrame:
    """Running mean of each series (series, ts, event_id, loss) over all rows that came so far, in order of (ts, event_id).

    Rows that come up to ``late`` after later ones take their place in the
    order; later ones are counted or dropped by the watermark. ``n_waiting`` of the ``n`` rows
    may still move. Needs a state store with several columns (``spark.sql.streaming.stateStore.providerClass`` of RocksDB).
    """
    rows = losses.withWatermark("ts", late).select("series", "ts", "event_id", "loss")
    timed = rows.withColumns({"at": F.col("ts"), "ts": F.unix_micros("ts")})
    out = "series long, ema double, n long, n_late long, n_waiting long"
    return timed.groupBy("series").transformWithStateInPandas(RunningMean(share, idle_ms), out, "Update", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store for streams that are started meanwhile."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def stream_view_metrics(views: DataFrame, metrics: list[str], late: str = "1 hour") -> DataFrame:
    """Means by scene and method as views arrive; a view that comes again within ``late`` counts once."""
    once = views.withWatermark("ts", late).dropDuplicatesWithinWatermark(["scene_id", "method", "name"])
    return once.groupBy("scene_id", "method").agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n_views"))


def last_batch(written: DataFrame, keys: list[str]) -> DataFrame:
    """Of update-mode rows the last one of each key."""
    values = [c for c in written.columns if c not in (*keys, "batch_id", "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")
