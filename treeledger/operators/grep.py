"""Trigram search: values, postings, candidates, and exact verification by line."""

from __future__ import annotations

import binascii
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import grams as planner

#: What is indexed: at most 8 MiB, no NUL in the first 8 KiB; a matched line is shown up to 512 bytes (fixed values).
MAX_TEXT_BYTES, NUL_BYTES, LINE_BYTES = 8 << 20, 8 << 10, 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """ASCII letters lower-cased, all others as they are."""
    return F.translate(text, _UPPER, _LOWER)


def eligible(contents: DataFrame) -> DataFrame:
    """contents with whether they are indexed as text: not too large, and the first bytes are UTF-8 without NUL; a character that the
    sample cuts is no fault."""
    head = F.substring(F.col("body").cast("binary"), 1, NUL_BYTES)
    size = F.octet_length(head)
    cut = F.lit(False)
    for k, lead in ((1, "(C[2-9A-F]|[DE].|F[0-4])"), (2, "(E.|F[0-4])[89AB]."), (3, "F[0-4][89AB].[89AB].")):
        tail = F.hex(F.substring(head, size - k + 1, F.lit(k)))
        cut = cut | ((size > k) & tail.rlike(f"^{lead}$") & F.is_valid_utf8(F.substring(head, F.lit(1), size - k).cast("string")))
    text = F.is_valid_utf8(head.cast("string")) | cut
    nul = F.instr(head.cast("string"), "\0") > 0
    return contents.withColumn("eligible", (F.octet_length("body") <= MAX_TEXT_BYTES) & text & ~nul)


def gram_rows(contents: DataFrame) -> DataFrame:
    """content_id, gram (6 hex digits) once per content: distinct 3-byte windows of the folded text.

    Windows are cut by numpy on Arrow batches, one text at a time; string functions would walk a text once per window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(body, np.uint8)
                if len(data) < 3:
                    continue
                data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
                wide = data.astype(np.uint32)
                values = np.unique(wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:])
                digits = binascii.hexlify(np.ascontiguousarray(values.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]).tobytes())
                offsets = np.arange(0, 6 * len(values) + 1, 6, dtype=np.int32)
                grams = pa.Array.from_buffers(pa.string(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(digits)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), content)), grams], names=["content_id", "gram"])

    return contents.select(F.col("content_id").cast("bigint"), F.col("body").cast("binary")).where("content_id is not null and body is not null").mapInArrow(run, "content_id bigint, gram string")


def postings(contents: DataFrame) -> DataFrame:
    """The index: a row per gram and content. Written range-partitioned by gram, a search reads a few files."""
    return gram_rows(eligible(contents).where("eligible"))


def build_index(contents: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """Writes postings of contents that the index doesn't have yet, sorted by gram."""
    new = contents if known is None else contents.join(known.select("content_id").distinct(), "content_id", "left_anti")
    postings(new).repartitionByRange("gram").sortWithinPartitions("gram", "content_id").write.mode("append").parquet(path)


def candidates(index: DataFrame, sets: planner.Sets) -> DataFrame:
    """content_id of those that meet every set: one pass over the postings of all named grams."""
    of: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        for g in s:
            of.setdefault(g.hex(), []).append(i)
    member = F.create_map(*(x for g, ids in of.items() for x in (F.lit(g), F.array(*map(F.lit, ids)))))
    hit = index.where(F.col("gram").isin(*of)).select("content_id", F.explode(member[F.col("gram")]).alias("s"))
    return hit.groupBy("content_id").agg(F.count_distinct("s").alias("n")).where(F.col("n") == len(sets)).select("content_id")


def _matched_lines(data: bytes, pattern: re.Pattern) -> Iterator[tuple[int, int, bytes, bool]]:
    """Number of the line that a match begins in, the match's place, the line's first bytes, and whether there are more. One walk
    over the text: a line is told once, and a match that goes on over lines hides the lines within it."""
    text = data.decode("utf-8", "surrogateescape")
    wide = len(text) != len(data)
    line_no, line_at, told, chars, at = 1, 0, -1, 0, 0
    for m in pattern.finditer(text):
        seen, at = at, at + (len(text[chars : m.start()].encode("utf-8", "surrogateescape")) if wide else m.start() - chars)
        chars = m.start()
        if ends := data.count(b"\n", seen, at):
            line_no, line_at = line_no + ends, data.rfind(b"\n", seen, at) + 1
        if line_at != told:
            told = line_at
            end = data.find(b"\n", at)
            line = data[line_at : min(len(data) if end < 0 else end, line_at + LINE_BYTES + 1)]
            yield line_no, at, line[:LINE_BYTES], len(line) > LINE_BYTES


def line_matches(contents: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """content_id, line_no (from 1), byte_offset of the first match that begins in the line, line (cut to 512 bytes), line_truncated.

    The dialect is that of Python's ``re`` without look-around and back-references, with ``^`` and ``$`` at lines' ends; only a
    line feed ends a line. Bytes that are no UTF-8, and a character that the cut of a line divides, are shown as U+FFFD.
    """
    planner.check(pattern)
    flags = re.MULTILINE | (re.IGNORECASE if ignore_case else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(pattern, flags)
        for batch in batches:
            found = [(c, *m) for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in _matched_lines(data, compiled)]
            ids, line_no, at, line, more = zip(*found, strict=True) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(line_no, pa.int64()), pa.array(at, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in line], pa.string()), pa.array(more, pa.bool_())], names=["content_id", "line_no", "byte_offset", "line", "line_truncated"])

    rows = contents.select(F.col("content_id").cast("bigint"), F.col("body").cast("binary").alias("body")).where("content_id is not null and body is not null")
    return rows.mapInArrow(run, "content_id bigint, line_no bigint, byte_offset bigint, line string, line_truncated boolean")


def grep(contents: DataFrame, index: DataFrame | None, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Matching lines of all contents, through the index where the pattern and the index allow it."""
    sets = planner.plan(pattern, ignore_case) if index is not None else None
    if sets:
        contents = contents.join(candidates(index, sets), "content_id", "left_semi")
    return line_matches(eligible(contents).where("eligible").select("content_id", "body"), pattern, ignore_case)


def files_with(matches: DataFrame, files: DataFrame, scope: str | None = None) -> DataFrame:
    """Matches of contents as matches of the files that now have them. files: inode_id, path, content_id."""
    if scope and scope != "/":
        files = files.where((F.col("path") == scope) | F.col("path").startswith(scope.rstrip("/") + "/"))
    return files.join(matches, "content_id").orderBy("content_id", "inode_id", "byte_offset")
