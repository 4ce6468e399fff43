"""Cases as they arrive: a stream of voxel files to features, one micro-batch after the other.

Each batch replaces the partitions (case, region, mode) it holds, so a batch that is run twice leaves the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlore.plans.engine import Engine
from gridlore.sources.container import write_features

IMAGE = "case_id string, z int, y int, x int, val double, roi_id string, label int"


def stream_features(spark: SparkSession, folder: str, out: str, engine: Engine, checkpoint: str, once: bool = True):
    """Watches a folder of Parquet files (IMAGE: roi_id and label are null outside regions; a case is never split over batches)."""

    def batch(rows: DataFrame, _):
        if rows.isEmpty():
            return
        rows = rows.persist()
        images = rows.dropDuplicates(["case_id", "z", "y", "x"]).select("case_id", "z", "y", "x", "val")
        masks = rows.filter("roi_id is not null").select("case_id", "roi_id", "z", "y", "x", "label")
        for mode, df in engine.execute(images, masks).items():
            write_features(df, out, mode)
        rows.unpersist()

    s = spark.readStream.schema(IMAGE).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (s.trigger(availableNow=True) if once else s).start()
