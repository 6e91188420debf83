"""Where lineage is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names; only a local session without one, as in tests, gets its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            root = tempfile.mkdtemp(prefix="quillmill-")
        context.setCheckpointDir(root)
    return df.checkpoint()
