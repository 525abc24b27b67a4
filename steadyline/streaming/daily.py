"""The same entity-day table and action log, kept up to date from a stream of records."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def entity_days_stream(records: DataFrame, metrics: dict[str, Column], late: str = "2 days") -> DataFrame:
    """Entity-days as one-day event-time windows; a day is emitted once, when the watermark has passed it."""
    day = F.window("ts", "1 day")
    daily = records.withWatermark("ts", late).groupBy("entity_id", day.alias("_w")).agg(
        *[expression.alias(name) for name, expression in metrics.items()]
    )
    return daily.select("entity_id", F.to_date("_w.start").alias("day"), *metrics)


def append_stream(rows: DataFrame, path: str, checkpoint: str, partition_by: str | None = None) -> StreamingQuery:
    """Append finished rows to parquet, exactly once per checkpoint, then stop when the input is used up."""
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return writer.trigger(availableNow=True).start(path)
