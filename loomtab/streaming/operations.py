"""Operations on streams. They are projections, so they need no state, watermark or shuffle, and append as rows come."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.operation import Operation, apply_named, checked, collected, measures, _named


def apply_stream(stream: DataFrame, op: Operation) -> DataFrame:
    """The stream with the operation done; columns as in the table form."""
    return apply_named(stream, op)


def write_stream(stream: DataFrame, op: Operation, path: str, checkpoint: str, on_stats=None, **trigger) -> StreamingQuery:
    """Appends to Parquet with exactly-once files; ``on_stats`` gets the statistics of each micro-batch.

    A batch that is run again after a failure replaces its folder. A row in error fails its batch.
    """
    columns = [*stream.columns, *op.names]

    def one(batch: DataFrame, number: int) -> None:
        done = checked(_named(batch, op), stream.columns, op).withColumn("batch", F.lit(number))
        done.select(*[F.col(f"`{c}`") for c in columns]).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_stats:
            on_stats(number, collected(op, done.agg(*measures(op)).collect()[0].asDict()))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
