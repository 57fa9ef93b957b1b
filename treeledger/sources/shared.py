"""Tables that cut lineage, in the folder that all executors share.

They lie in a folder of the running application below spark.checkpoint.dir, and go with it when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANED: set[str] = set()


def _shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it. Where it is unset, a temporary folder in local mode (tests, one machine);
    on a cluster that would be each machine's own, so there it is an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before the interpreter: the folder stays for the cluster's own cleaning
        pass


def folder(spark: SparkSession) -> str:
    """The application's own folder."""
    own = f"{_shared(spark)}/{spark.sparkContext.applicationId}"
    if own not in _CLEANED:
        _CLEANED.add(own)
        atexit.register(_remove, spark, own)
    return own


def stored(frame: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
    """The rows of frame, written once (in folders by some columns, in order of seq) and read again: computed once, and kept when executors are lost."""
    spark, path = frame.sparkSession, f"{folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    keys = [*by, "seq", *(c for c in ("delta_index",) if c in frame.columns)]  # one commit may be most of a folder
    writer = frame.repartitionByRange(*keys).sortWithinPartitions(*by, "seq").write.partitionBy(*by) if by else frame.write
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path).select(*frame.columns)


def remains(frame: DataFrame) -> bool:
    """Whether the files of a stored table are all still there."""
    spark = frame.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in frame.inputFiles()]
    return all(p.getFileSystem(conf).exists(p) for p in paths)
