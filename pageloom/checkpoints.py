"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _folder(df: DataFrame) -> str:
    """The session's checkpoint folder, set up where the session names none."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="pageloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the checkpoint folder: for wide rows that several jobs read again.

    The folder goes when the driver ends.
    """
    path = f"{_folder(df)}/table-{uuid.uuid4().hex}"
    jvm = df.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder of the session, without its lineage.

    The folder is the one in ``spark.checkpoint.dir``.  Only where that is unset - local
    runs and tests - a temporary folder is taken.
    """
    _folder(df)
    return df.checkpoint(eager=True)


#: So many narrow rows (names, numbers) of a counted table may be broadcast: some tens of megabytes.
FEW = 1_000_000


def counted(df: DataFrame, few: int = FEW) -> DataFrame:
    """A written, narrow table for a join: marked for broadcast where counting shows at most ``few`` rows, else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() <= few else df
