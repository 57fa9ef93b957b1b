"""Tables that cut lineage, in the folder that all executors share.

They lie in a folder of the running application below spark.checkpoint.dir, and go with it when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it. Where it is unset, a temporary folder in local mode (tests, one machine);
    on a cluster that would be each machine's own, so there it is an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before the interpreter: the folder stays for the cluster's own cleaning
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    own = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if own not in _CLEANED:
        _CLEANED.add(own)
        atexit.register(_remove, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows of frame, written once as Parquet in the shared folder and read again: computed once, kept when executors are lost."""
    spark, path = frame.sparkSession, new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
