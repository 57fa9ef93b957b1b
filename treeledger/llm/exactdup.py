"""Exact deduplication by counting quotient filters.

Texts are compared without the characters ``[\\x20\\x09-\\x0D]``. A 64-bit fingerprint of each falls, by its leading bits,
into a slice; within it the next bits are the quotient, the others the remainder. Every partition builds one filter a
slice: per quotient a run of sorted remainders, with counters. The filters of a slice share their geometry, so they merge
without loss and without sorting anew: quotient by quotient runs merge in order of remainder, and counters of equal ones add up.
Fingerprints with a count above one route their rows to a comparison of the whole bytes; all others are known to be alone.

Of equal texts the row with the most code points, then the least doc_id (null after all others), stays.

Defined cases: null text is empty, and empty texts are equal; rows repeated with one doc_id count each in group_size and
all say kept if that doc_id stays (``keep`` passes on one of them); an empty table gives no rows; further columns are
ignored (``keep`` passes them on).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .textkit import mapped, text_slices

#: Fingerprints that a slice is made for, and repeated fingerprints (8 bytes each) or groups that may be broadcast.
SLICE_ROWS, MAX_BROADCAST, MAX_BROADCAST_GROUPS = 1 << 19, 2_000_000, 200_000
#: Bits of a quotient: a slice has this many runs.
QUOTIENT_BITS = 18
_DROP = bytes([0x20, *range(0x09, 0x0E)])


class CountingQuotientFilter:
    """Fingerprints of one slice (its leading bits dropped): the quotients that occur, the ends of their runs, sorted remainders, counters."""

    def __init__(self, bits: int, quotients: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> None:
        self.bits, self.quotients, self.ends, self.remainders, self.counts = bits, quotients, ends, remainders, counts

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """values: sorted, distinct, of so many bits; counts: how often each occurs."""
        low = np.uint64(bits - QUOTIENT_BITS)
        return cls._runs(bits, values >> low, values & ((np.uint64(1) << low) - np.uint64(1)), counts)

    @classmethod
    def _runs(cls, bits: int, quotient: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(quotient)), bool), quotient[1:] != quotient[:-1])))
        return cls(bits, quotient[begin].astype(np.uint32), np.append(begin[1:], len(quotient)).astype(np.uint32) if len(begin) else np.zeros(0, np.uint32), remainders, counts)

    def _quotient(self) -> np.ndarray:
        """The quotient of every remainder."""
        return np.repeat(self.quotients, np.diff(self.ends, prepend=np.uint32(0)))

    def values(self) -> np.ndarray:
        return (self._quotient().astype(np.uint64) << np.uint64(self.bits - QUOTIENT_BITS)) | self.remainders

    def dump(self) -> bytes:
        width = -(-(self.bits - QUOTIENT_BITS) // 8)
        many = np.flatnonzero(self.counts > 1).astype(np.uint32)
        head = np.array([self.bits, len(self.quotients), len(self.remainders), len(many)], np.uint32)
        return b"".join((head.tobytes(), self.quotients.tobytes(), self.ends.tobytes(), np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes(), many.tobytes(), self.counts[many].astype(np.uint64).tobytes()))

    @classmethod
    def load(cls, blob: bytes) -> CountingQuotientFilter:
        bits, k, n, m = (int(x) for x in np.frombuffer(blob, np.uint32, 4))
        at, width = 16 + 8 * k, -(-(bits - QUOTIENT_BITS) // 8)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counts = np.ones(n, np.int64)
        counts[np.frombuffer(blob, np.uint32, m, at)] = np.frombuffer(blob[at + 4 * m :], np.uint64, m)
        return cls(bits, np.frombuffer(blob, np.uint32, k, 16), np.frombuffer(blob, np.uint32, k, 16 + 4 * k), wide.view("<u8").ravel(), counts)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' fingerprints. Each remainder of the other finds its place in the run of its quotient; nothing is sorted."""
        a, b = self.values(), other.values()
        place = np.searchsorted(a, b)
        known = np.zeros(len(b), bool)
        inside = place < len(a)
        known[inside] = a[place[inside]] == b[inside]
        counts = self.counts.copy()
        counts[place[known]] += other.counts[known]
        new = ~known
        at = place[new]
        return self._runs(self.bits, np.insert(self._quotient(), at, other._quotient()[new]), np.insert(self.remainders, at, other.remainders[new]), np.insert(counts, at, other.counts[new]))

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """All filters, merged by twos, so that every fingerprint moves a logarithm of times."""
        while len(filters) > 1:
            filters = [filters[i].merge(filters[i + 1]) if i + 1 < len(filters) else filters[i] for i in range(0, len(filters), 2)]
        return filters[0]


def normalised(texts: pa.Array) -> list[bytes]:
    return [x.translate(None, _DROP) for x in texts.cast(pa.binary()).to_pylist()]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, fp, n_chars and sha (of the normalised text) of every row."""

    def work(batch):
        for part, texts in text_slices(batch):
            plain = normalised(texts)
            yield {"doc_id": part.column(0), "fp": np.array([xxhash.xxh64_intdigest(x) for x in plain], np.uint64).view(np.int64), "n_chars": pc.utf8_length(texts), "sha": pa.array([hashlib.sha256(x).digest() for x in plain], pa.binary())}

    return mapped(docs.select("doc_id", "text"), work, "doc_id long, fp long, n_chars long, sha binary")


def repeated(rows: DataFrame) -> DataFrame:
    """Fingerprints with a count above one, by way of merged filters: fp, n."""
    bits = max(0, (rows.count() // SLICE_ROWS).bit_length())
    left = 64 - bits

    def build(batches):
        seen = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        values, counts = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
        if not len(values):
            return
        part = (values >> np.uint64(left)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(cut, np.append(cut[1:], len(values)), strict=True):
            filter_ = CountingQuotientFilter.of(values[lo:hi] & np.uint64((1 << left) - 1), counts[lo:hi], left)
            yield pa.RecordBatch.from_arrays([pa.array([part[lo]]), pa.array([filter_.dump()], pa.binary())], names=["slice", "filter"])

    def merge(table: pa.Table) -> pa.Table:
        whole = CountingQuotientFilter.merged([CountingQuotientFilter.load(x) for x in table.column("filter").to_pylist()])
        many = whole.counts > 1
        values = whole.values()[many] | np.uint64((table.column("slice")[0].as_py() << left) if bits else 0)
        return pa.table({"fp": values.view(np.int64), "n": whole.counts[many]})

    return rows.select("fp").mapInArrow(build, "slice long, filter binary").groupBy("slice").applyInArrow(merge, "fp long, n long")


def groups(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """fp, sha, keep_id, keep_chars, group_size of every group of two or more equal texts, compared byte for byte."""
    many = written(repeated(rows), "repeated")
    small = many.count() <= MAX_BROADCAST
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(many.select("fp").toArrow().column(0), np.int64))) if small else None

    def work(batch):
        for part, texts in text_slices(batch):
            plain = normalised(texts)
            fp = np.array([xxhash.xxh64_intdigest(x) for x in plain], np.uint64).view(np.int64)
            chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.isin(fp, shared.value)) if small else np.arange(len(fp))
            yield {"doc_id": part.column(0).take(pa.array(at)), "fp": fp[at], "n_chars": chars[at], "plain": pa.array([plain[i] for i in at], pa.binary())}

    routed = mapped(docs.select("doc_id", "text"), work, "doc_id long, fp long, n_chars long, plain binary")
    if not small:
        routed = routed.join(many.select("fp"), "fp")
    best = F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")).alias("best")
    out = routed.groupBy("fp", "plain").agg(best, F.count("*").alias("group_size")).where("group_size > 1")
    return out.select("fp", F.unhex(F.sha2("plain", 256)).alias("sha"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.short")).alias("keep_chars"), "group_size")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = written(fingerprinted(docs), "fingerprints")
    found = written(groups(docs, rows), "groups")
    if found.count() <= MAX_BROADCAST_GROUPS:
        found = F.broadcast(found)
    out = rows.join(found, ["fp", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    kept = F.col("group_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group, columns unchanged.

    Rows to drop are few, and named by doc_id and digest; they are looked up in the pass over docs where they are few enough
    to be broadcast, and joined otherwise. Of rows repeated with the surviving doc_id one stays.
    """
    rows = written(fingerprinted(docs), "fingerprints")
    found = written(groups(docs, rows), "groups")
    text = docs.columns.index("text")
    ids = docs.columns.index("doc_id")
    whole = [f"c{i}" for i in range(len(docs.columns))]

    def tagged(batches):
        for batch in batches:
            for part, texts in text_slices(batch.rename_columns(whole), f"c{text}"):
                plain = normalised(texts)
                more = [np.array([xxhash.xxh64_intdigest(x) for x in plain], np.uint64).view(np.int64), pc.utf8_length(texts).cast(pa.int64()), pa.array([hashlib.sha256(x).digest() for x in plain], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, more)], names=[*whole, "fp", "n_chars", "sha"])

    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    schema = StructType([*(StructField(w, f.dataType) for w, f in zip(whole, docs.schema, strict=True)), StructField("fp", LongType()), StructField("n_chars", LongType()), StructField("sha", BinaryType())])
    small = found.count() <= MAX_BROADCAST_GROUPS
    out = docs.mapInArrow(tagged, schema).join(F.broadcast(found) if small else found, ["fp", "sha"], "left")
    doc_id = F.col(f"c{ids}")
    alone = out.where("group_size is null").select(*whole)
    best = out.where(F.col("group_size").isNotNull() & doc_id.eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).dropDuplicates(["fp", "sha"]).select(*whole)
    return alone.unionByName(best).toDF(*docs.columns)
