"""Two streams: tiles that arrive pass the quality gate, and metrics are averaged by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.stats import pixel_sum
from ..operators.gates import drop_corrupt, filter_log_sum, log_sum_passes


def quality_gate(tiles: DataFrame, low: float = 2.0, high: float = 7.0) -> DataFrame:
    """Whole tiles within the log-sum limits, of a batch or a stream: no state."""
    return filter_log_sum(drop_corrupt(tiles, ["pixels"]), "pixels", low, high)


def paired_gate(low_tiles: DataFrame, high_tiles: DataFrame, low: float = 2.0, high: float = 7.0, wait: str = "1 hour") -> DataFrame:
    """Tiles (name, ts, pixels) of both surveys as pairs (name, low_ts, high_ts, low_pixels, high_pixels, status), of batches or streams.

    A pair has one name and times at most `wait` apart. It is accepted if both tiles are whole and the high-resolution one is within the
    log-sum limits, else rejected. A tile whose partner hasn't come when the watermark, `wait` behind the latest tile, rules it out is unpaired:
    that goes to quarantine, as do tiles without a name. State is kept for tiles that can still find a partner. A stream drops a tile that comes
    in a later batch than one more than `wait` after it, so batches have to follow the time to within `wait`; within a batch any order will do.
    """
    a = low_tiles.select(F.col("name").alias("low_name"), F.col("ts").alias("low_ts"), F.col("pixels").alias("low_pixels"))
    b = high_tiles.select(F.col("name").alias("high_name"), F.col("ts").alias("high_ts"), F.col("pixels").alias("high_pixels"))
    a, b = (df.withWatermark(ts, wait) if df.isStreaming else df for df, ts in ((a, "low_ts"), (b, "high_ts")))
    near = F.expr(f"low_name = high_name AND high_ts >= low_ts - INTERVAL {wait} AND high_ts <= low_ts + INTERVAL {wait}")
    whole = F.col("low_pixels").isNotNull() & F.col("high_pixels").isNotNull()
    status = F.when(F.col("low_name").isNull() | F.col("high_name").isNull(), "unpaired").when(whole & log_sum_passes(pixel_sum("high_pixels"), low, high), "accepted").otherwise("rejected")
    return a.join(b, near, "full_outer").select(F.coalesce("low_name", "high_name").alias("name"), "low_ts", "high_ts", "low_pixels", "high_pixels", status.alias("status"))


def windowed_metrics(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Mean and count per metric and tumbling window; rows later than the watermark are dropped by a stream."""
    grouped = events.withWatermark("ts", late) if events.isStreaming else events
    means = grouped.groupBy(F.window("ts", length).alias("w"), "metric").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))
    return means.select(F.col("w.start").alias("window_start"), "metric", "mean_value", "n")


def run_once(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there into Parquet under path, then stop; the checkpoint makes it go on next time."""
    query = result.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
