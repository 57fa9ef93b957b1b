"""Proportional stratified interleaving, with DataFrame functions only.

Rows of a source are shuffled by a seeded digest of doc_id and text CRC and ranked 0 .. n-1; the row of rank r stands at the fraction
``(r + u) / n``, u being the source's own seeded offset (else all sources of one row would meet at one point). All rows in
order of fraction are cut into shards of equal counts, so each shard has its share of every source. Law: ``rows`` (counts
at most one apart). The method mixes sources; it does not keep equal texts together.

Ranks within a source, and places over all rows, come from counts of 4,096 buckets plus a rank inside a bucket, so neither
a source with a third of all rows, nor a doc_id that many texts share, nor the global order meets in one task. The text is read
once, for its size and CRC; these are written, and nothing else is shuffled.

Defined cases: null source is the source ``''``; null text has size 8 and CRC 0; repeated rows get a slot each; rows that
tie in digest are ordered by doc_id, CRC and size; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

N_SHARDS, SEED = 24, "interleave-1"
#: Fractions are integers below 2^24; a bucket is 2^12 of them. Digests fall in 16^3 buckets.
SCALE, BUCKET = 1 << 24, 1 << 12


def _digest(column) -> F.Column:
    return F.md5(F.concat(F.lit(SEED), F.coalesce(column.cast("string"), F.lit(""))))


def interleaved(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, source, shard, slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = written(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "sizes")
    key = _digest(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")))
    rows = sized.select("*", key.alias("digest"), F.substring(key, 1, 3).alias("bucket"))

    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n_bucket"))
    within = Window.partitionBy("source")
    before = counts.select("source", "bucket", (F.sum("n_bucket").over(within.orderBy("bucket")) - F.col("n_bucket")).alias("before"), F.sum("n_bucket").over(within).alias("n_source"))

    rank = F.col("before") + F.row_number().over(Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "text_crc32", "size")) - 1
    offset = F.conv(F.substring(_digest(F.col("source")), 1, 6), 16, 10).cast("long")
    placed = rows.join(before, ["source", "bucket"]).select("doc_id", "size", "text_crc32", "source", "n_source", rank.alias("rank"))
    point = F.expr(f"(rank * {SCALE} + offset) div n_source").alias("point")
    placed = written(placed.withColumn("offset", offset).select("doc_id", "size", "text_crc32", "source", "rank", point), "interleave")

    band = F.expr(f"point div {BUCKET}")
    every = Window.partitionBy(F.lit(0))  # at most SCALE / BUCKET rows
    bands = placed.groupBy(band.alias("band")).agg(F.count("*").alias("n_band"))
    bands = bands.select("band", (F.sum("n_band").over(every.orderBy("band")) - F.col("n_band")).alias("ahead"), F.sum("n_band").over(every).alias("n_rows"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("band").orderBy("point", "source", "rank")) - 1
    out = placed.withColumn("band", band).join(F.broadcast(bands), "band").withColumn("place", place)
    shard = F.expr(f"place * {n_shards} div n_rows")
    return out.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", "source", "shard", (F.col("place") - F.expr(f"(shard * n_rows + {n_shards - 1}) div {n_shards}")).alias("slot"))
