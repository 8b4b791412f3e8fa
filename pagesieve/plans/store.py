"""Tables that later steps read several times."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df written once to the folder in spark.checkpoint.dir, which driver and executors share; its plan starts from there.

    A temporary folder takes its place only where that is unset and the master is local, as in tests.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="pagesieve-"))
    return df.checkpoint()
