"""Structured Streaming over the commit log: change feed, fold, and incremental search index.

Order is by sequence, never by event time, so there are no watermarks. A commit is written to one file of the log, so a
micro-batch holds whole commits. Every step writes a folder of its batch, so a repeated batch overwrites what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..operators import changes, families, grep


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(S.DELTAS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def follow(spark: SparkSession, log: str, out: str, checkpoint: str, after: int = 0) -> StreamingQuery:
    """Events of new commits in ``out``, a folder a batch; resumes from its checkpoint."""

    def step(batch: DataFrame, number: int) -> None:
        changes.events(batch, after).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return log_stream(spark, log).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold(spark: SparkSession, log: str, runs: str, checkpoint: str) -> StreamingQuery:
    """Every batch of the log as one run of each family; a repeated batch overwrites its own run."""

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, make in families.FAMILIES.items():
            make(batch).write.mode("overwrite").parquet(f"{runs}/{name}/run={number}")
        batch.unpersist()

    return log_stream(spark, log).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index(spark: SparkSession, log: str, contents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Postings of content values that commits newly refer to, in ``out``/postings, and the values looked at with whether they are text, in
    ``out``/texts: a value that is there isn't read again, and the postings aren't read at all."""
    schema = "content_id bigint, eligible boolean, batch bigint"

    def step(batch: DataFrame, number: int) -> None:
        new = families.revisions(batch).select("content_id").distinct()
        if number:
            known = spark.read.schema(schema).parquet(f"{out}/texts").where(F.col("batch") < number).select("content_id")
            new = new.join(known, "content_id", "left_anti")
        read = grep.eligible(contents.join(new, "content_id", "left_semi")).persist()
        read.select(F.col("content_id").cast("bigint"), "eligible").write.mode("overwrite").parquet(f"{out}/texts/batch={number}")
        rows = grep.gram_rows(read.where("eligible"))
        rows.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
        read.unpersist()

    return log_stream(spark, log).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def group_commits(spark: SparkSession, requests: DataFrame, log_path: str, receipts: str, checkpoint: str, interval: str = "200 milliseconds", once: bool = False) -> StreamingQuery:
    """Commits that wait at a trigger become one object of the log, with consecutive sequences in order of arrival; the first of each
    commit_id alone. requests: commit_id, arrived_ms, and delta_index, kind and further delta columns. A repeated batch keeps the
    sequences it gave: they follow from the receipts of earlier batches alone."""
    schema = "commit_id string, seq bigint, batch bigint"

    def step(batch: DataFrame, number: int) -> None:
        done = spark.read.schema(schema).parquet(receipts).where(F.col("batch") < number) if number else spark.createDataFrame([], schema)
        head = done.agg(F.max("seq")).first()[0] or 0
        fresh = batch.join(done.select("commit_id"), "commit_id", "left_anti").persist()
        order = fresh.groupBy("commit_id").agg(F.min("arrived_ms").alias("arrived_ms"))
        place = F.row_number().over(Window.orderBy("arrived_ms", "commit_id"))  # a row for each commit of one trigger
        told = order.select("commit_id", (F.lit(head) + place).alias("seq")).persist()
        told.write.mode("overwrite").parquet(f"{receipts}/batch={number}")
        rows = fresh.drop("seq").join(told, "commit_id")
        cols = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in S.DELTA_COLUMNS.items()]
        rows.select(*cols).coalesce(1).write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        fresh.unpersist()
        told.unpersist()

    writer = requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def deduplicated(stream: DataFrame) -> DataFrame:
    """First commit of every commit_id in a stream of commits; state is kept per id."""
    return stream.dropDuplicates(["commit_id"])
