"""Storage that all machines share, for results that later steps start from."""

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, computed now and kept as files in spark.checkpoint.dir; its plan is forgotten. Where the session names no such
    folder, as in tests, a temporary one is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="driftspan-"))
    return df.checkpoint(eager=True)
