"""What a stream gives until its source is read, as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; elsewhere on a local master only."""
    if not (root := spark.conf.get("spark.checkpoint.dir", None)):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, newest: str | None = None, folder: str | None = None) -> DataFrame:
    """The rows of a stream read to the end of its source, written exactly once and read back.

    mode "update": every batch gives the groups it changed, whole windows still open among them; of each group (keys) the row
    with the largest `newest` is its last. With the folder of an earlier run it goes on where that one stopped.
    """
    folder = folder or shared_folder(stream.sparkSession)
    rows, state = f"{folder}/rows", f"{folder}/state"
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", rows).option("checkpointLocation", state)
    else:
        # A batch that is tried again writes to its own folder again.
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{rows}/batch={n}")).option("checkpointLocation", state)
    q.trigger(availableNow=True).start().awaitTermination()
    out = stream.sparkSession.read.schema(stream.schema).parquet(rows)
    if keys:
        last = Window.partitionBy(*keys).orderBy(F.desc(newest))
        out = out.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")
    return out.select(*stream.columns)
