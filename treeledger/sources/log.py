"""The commit log as files: an append-only folder of Parquet deltas, and compacted runs partitioned by family.

Any Hadoop file system works by its URI (``s3a://``, ``gs://``, ``abfss://``, ``hdfs://``, ``file://``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S
from ..operators import families, retention


class Taken(ValueError):
    """The log has an object of that number."""


def append(deltas: DataFrame, path: str, number: int | None = None) -> None:
    """Appends a batch of whole commits; each lies in one file, and a file's rows are not sorted, as a commit may be of any size. With a number the batch is the log's object of that number, which
    only one writer can put: the mark is made if absent, before any row is written."""
    if number is not None:
        spark = deltas.sparkSession
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_taken-{number:020d}")
        if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(mark):
            raise Taken(f"object {number} is there")
    deltas.select(*S.DELTA_COLUMNS).repartitionByRange("seq").write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.DELTAS).parquet(path)


def replay(spark: SparkSession, path: str, folded: int = -1) -> DataFrame:
    """Deltas after the folded sequence, up to the first gap."""
    return retention.contiguous(read(spark, path), folded)


def write_run(kept: dict[str, DataFrame], path: str) -> None:
    """One folder per family, range-partitioned and sorted by its entity, so that row-group statistics prune point reads."""
    order = {"inodes": ["inode_id"], "bindings": ["parent_id", "name_key", "seq"], "revisions": ["inode_id", "revision_no"], "tombstones": ["root_id", "seq"], "trash": ["deletion_seq", "root_id"], "attributes": ["inode_id", "attributes_revision_no"], "access": ["inode_id", "access_revision_no"]}
    for name, rows in kept.items():
        keys = order[name]
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{name}")


def read_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in families.FAMILIES}


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Objects below a folder: key, size_bytes, modified_ms; the listing that collection starts from."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).selectExpr("path key", "length size_bytes", "unix_millis(modificationTime) modified_ms")
