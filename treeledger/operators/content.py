"""Ranges of file contents, and Bloom filters over keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reads import View

#: Bits a key, hashes a key and the largest filter in bytes (fixed values).
BITS_PER_KEY, HASHES, MAX_FILTER_BYTES = 10, 7, 64 << 20


def read_range(view: View, contents: DataFrame, ids: DataFrame, offset: int = 0, length: int | None = None) -> DataFrame:
    """inode_id, revision_no, size_bytes, and the bytes [offset, offset + length) of the newest revision of the given files, cut at
    the end. contents: content_id, body. A file without a revision has no row."""
    if offset < 0 or length is not None and length < 0:
        raise ValueError("negative range")
    rows = view.revision(ids).select("inode_id", "revision_no", "size_bytes", "content_id").join(contents.select("content_id", "body"), "content_id")
    data = F.col("body").cast("binary")
    part = F.substring(data, offset + 1, (1 << 31) - 1 - offset if length is None else length)
    return rows.select("inode_id", "revision_no", "size_bytes", part.alias("data"))


def bloom_bits(n_keys: int) -> int:
    return 64 * max(1, math.ceil(min(n_keys * BITS_PER_KEY, 8 * MAX_FILTER_BYTES) / 64))


def _places(key, bits: int):
    """The bits of a key: two hashes give all others."""
    h1, h2 = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.pmod(F.pmod(h1, F.lit(bits)) + i * (F.pmod(h2, F.lit(bits - 1)) + 1), F.lit(bits)))


def bloom_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """word, mask: the words of the filter that have a bit. Set bits are joined before the shuffle, so it moves words, not keys."""
    at = keys.select(F.explode(_places(F.col(key), bits)).alias("at")).select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("mask"))
    return at.groupBy("word").agg(F.bit_or("mask").alias("mask"))


def may_contain(rows: DataFrame, key: str, words: DataFrame, bits: int) -> DataFrame:
    """rows with may_contain: false for keys that are surely not in the filter (a table of at most 8 M words)."""
    told = rows.select(key).distinct().withColumn("at", F.explode(_places(F.col(key), bits)))
    told = told.withColumn("word", F.expr("at div 64")).withColumn("bit", F.expr("shiftleft(1L, cast(at % 64 as int))"))
    hit = told.join(words, "word", "left").groupBy(key).agg(F.min((F.coalesce("mask", F.lit(0)).bitwiseAND(F.col("bit")) != 0).cast("int")).alias("all_set"))
    return rows.join(hit, key).withColumn("may_contain", F.col("all_set") == 1).drop("all_set")
