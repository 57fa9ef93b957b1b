"""Arrow-level text primitives shared by the operators.

All functions work on one Arrow batch at a time; none keeps a document. Words are split on the bytes 0x20 and
0x09-0x0D only, which on UTF-8 is the character class ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step looks at; bounds the temporary arrays of a Python worker.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in slices of about SLICE_BYTES, each with its texts (null: empty)."""
    at = batch.schema.get_field_index(column)
    texts = batch.column(at)
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the n + 1 offsets of the texts in them."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def packed(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in data."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words in order, the n + 1 offsets of the texts in words, and where each word starts in data."""
    space = _SPACE[data]
    solid = ~space
    begins = solid.copy()
    begins[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = solid[first]
    at = np.flatnonzero(begins)
    before = np.concatenate(([0], np.cumsum(solid)))
    return packed(data[solid], np.append(before[at], before[-1])), np.searchsorted(at, offsets), at


def interned(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, and the distinct words by number."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def windows(n_words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of the first word of every full window within one text, and the text of each window."""
    offsets = np.concatenate(([0], np.cumsum(n_words)))
    count = np.maximum(n_words - width + 1, 0)
    doc = np.repeat(np.arange(len(n_words)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return offsets[doc] + inside, doc


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def release() -> None:
    """Gives freed memory back; a Python worker lives on through many stages, and its peaks would add up over workers."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def mapped(frame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str):
    """mapInArrow over text slices: work gives columns by name for each slice."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name].cast(f.type) for f in arrow], schema=arrow)
            release()

    return frame.mapInArrow(run, kind)
