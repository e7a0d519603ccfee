"""Score a stream with a fitted run: every step is row-wise after the fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabweave.automl import FittedTable
from tabweave.models.neighbours import NeighboursModel


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet", **options) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).options(**options).format(kind).load(path)


def score_stream(fitted: FittedTable, stream: DataFrame, output: str, checkpoint: str, kind: str = "parquet", trigger: dict | None = None) -> StreamingQuery:
    """Write predictions as rows arrive; the checkpoint makes each file count once.

    A neighbour model joins the rows with its training table, which needs whole batches, so it is
    run per micro-batch.
    """
    trigger = trigger or {"availableNow": True}
    if any(isinstance(s, NeighboursModel) for s in fitted.model.stages):

        def write(batch: DataFrame, number: int) -> None:
            fitted.transform(batch).write.mode("overwrite").format(kind).save(f"{output}/batch={number}")

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    return (
        fitted.transform(stream)
        .writeStream.format(kind)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start(output)
    )
