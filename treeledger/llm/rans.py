"""Token ids in files coded by a static range asymmetric numeral system.

Format of a file (little-endian): ``RANSv1``, uint16 0, then five uint64 (documents, ids, bytes of the document table, of the frequency
table, of the block table), the three tables compressed by zlib, and the blocks. The document table has doc_ids (int64),
a null mark (uint8) and lengths (uint64). The frequency table (symbols uint32, frequencies uint32 that sum to 2^20) is
shared by all blocks of the file. A block holds up to 2^20 ids over up to 4,096 interleaved lanes of 64-bit state
with 32-bit words; its entry in the block table has its number of ids, lanes and words, the place of its data and the CRC32 of its
ids (uint64 each). A block's data begins with a checkpoint, the lanes' states, so any block is decoded alone, and its
checksum tells whether it came out right.

Files are written by tasks over ranges of doc_id, first under a hidden name and then renamed, so a repeated task leaves
the same file. They are read back block by block, in parallel: a task reads a file's tables and the bytes of its blocks; the
checksums of a document that lies in several blocks are joined.

Defined cases: null text is empty and has the end id only; a null doc_id comes first; repeated rows are written each;
an empty table writes no file; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gptids import loaded
from .storage import new_folder, written
from .textkit import mapped, text_slices

END_ID = 2
PROBABILITY_BITS, LOW = 20, np.uint64(1 << 31)
BLOCK_IDS, LANES = 1 << 20, 4096
#: Blocks that a task reads.
BLOCKS_PER_TASK = 4
#: Ids after which a task closes a file and begins another.
FILE_IDS = 1 << 23
#: Files whose offsets may be broadcast.
MAX_BROADCAST_FILES = 200_000
_MAGIC = b"RANSv1\0\0"


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct symbols and their frequencies, each at least 1, with the sum 2^PROBABILITY_BITS."""
    count = np.bincount(ids)
    symbols = np.flatnonzero(count)
    whole = 1 << PROBABILITY_BITS
    if len(symbols) > whole:
        raise ValueError("more symbols than the table has room for")
    share = 1 + count[symbols].astype(np.int64) * (whole - len(symbols)) // max(1, len(ids))
    if len(share):
        share[np.argmax(share)] += whole - share.sum()
    return symbols.astype(np.uint32), share.astype(np.uint32)


def encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final states of the lanes and the words in the order in which a decoder reads them. freq, cum: by symbol."""
    lanes = min(LANES, len(ids))
    state, out, bits = np.full(lanes, LOW, np.uint64), [], np.uint64(PROBABILITY_BITS)
    for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        symbol = ids[at : at + lanes]
        f, x = freq[symbol], state[: len(symbol)]
        over = np.flatnonzero(x >= f << np.uint64(63 - PROBABILITY_BITS))
        out.append(x[over].astype(np.uint32))
        x[over] >>= np.uint64(32)
        q = x // f
        state[: len(symbol)] = (q << bits) + (x - q * f) + cum[symbol]
    return state, np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)


def decode_block(n: int, state: np.ndarray, words: np.ndarray, symbol_at: np.ndarray, freq_at: np.ndarray, bias_at: np.ndarray) -> np.ndarray:
    """The ids. The last three tables are by slot: symbol, its frequency, and the slot's place within it."""
    lanes, state, at, mask = len(state), state.copy(), 0, np.uint64((1 << PROBABILITY_BITS) - 1)
    out, bits = np.empty(n, np.uint32), np.uint64(PROBABILITY_BITS)
    for i in range(0, n, lanes):
        x = state[: min(lanes, n - i)]
        slot = (x & mask).astype(np.int64)
        out[i : i + lanes] = symbol_at[slot]
        x = freq_at[slot] * (x >> bits) + bias_at[slot]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
        at += len(low)
        state[: len(x)] = x
    if at != len(words) or (state != LOW).any():
        raise ValueError("block does not end in its initial state")
    return out


def dump(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    symbols, share = frequencies(ids)
    freq, cum = np.zeros(int(symbols.max(initial=0)) + 1, np.uint64), np.zeros(int(symbols.max(initial=0)) + 1, np.uint64)
    freq[symbols] = share
    cum[symbols] = np.cumsum(share) - share
    blocks, entries, place = [], [], 0
    for at in range(0, len(ids), BLOCK_IDS):
        part = ids[at : at + BLOCK_IDS]
        state, words = encode_block(part, freq, cum)
        data = state.astype("<u8").tobytes() + words.astype("<u4").tobytes()
        entries.append((len(part), len(state), len(words), place, zlib.crc32(part.astype("<u4").tobytes())))
        blocks.append(data)
        place += len(data)
    null = np.array([d is None for d in doc_ids], np.uint8)
    tables = [zlib.compress(x, 1) for x in (np.array([d or 0 for d in doc_ids], "<i8").tobytes() + null.tobytes() + lengths.astype("<u8").tobytes(), symbols.astype("<u4").tobytes() + share.astype("<u4").tobytes(), np.array(entries, "<u8").tobytes())]
    return b"".join((_MAGIC, struct.pack("<5Q", len(doc_ids), len(ids), *map(len, tables)), *tables, *blocks))


class Head:
    """The tables of a file. ``read`` gives n bytes from a place of the file."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        start = read(0, 48)
        if start[:8] != _MAGIC:
            raise ValueError("not a file of this format")
        n_docs, self.n_ids, *sizes = struct.unpack_from("<5Q", start, 8)
        tables, packed = [], read(48, sum(sizes))
        for size in sizes:
            tables.append(zlib.decompress(packed[:size]))
            packed = packed[size:]
        self.data = 48 + sum(sizes)
        self.doc_ids = np.frombuffer(tables[0], "<i8", n_docs).tolist()
        for i in np.flatnonzero(np.frombuffer(tables[0], np.uint8, n_docs, 8 * n_docs)):
            self.doc_ids[i] = None
        self.lengths = np.frombuffer(tables[0], "<u8", n_docs, 9 * n_docs).astype(np.int64)
        k = len(tables[1]) // 8
        symbols, share = np.frombuffer(tables[1], "<u4", k), np.frombuffer(tables[1], "<u4", k, 4 * k)
        self.symbol_at, self.freq_at = np.repeat(symbols, share), np.repeat(share, share).astype(np.uint64)
        self.bias_at = np.arange(len(self.symbol_at), dtype=np.uint64) - np.repeat(np.cumsum(share, dtype=np.uint64) - share, share)
        self.blocks = np.frombuffer(tables[2], "<u8").reshape(-1, 5).tolist()
        if sum(b[0] for b in self.blocks) != self.n_ids:
            raise ValueError("file is short of ids")

    def block(self, k: int, read: Callable[[int, int], bytes]) -> np.ndarray:
        """The ids of one block, from its own bytes alone; raises where its checksum fails."""
        n, lanes, n_words, place, crc = self.blocks[k]
        data = read(self.data + place, 8 * lanes + 4 * n_words)
        part = decode_block(n, np.frombuffer(data, "<u8", lanes), np.frombuffer(data, "<u4", n_words, 8 * lanes), self.symbol_at, self.freq_at, self.bias_at)
        if zlib.crc32(part.astype("<u4").tobytes()) != crc:
            raise ValueError("block checksum differs")
        return part


def load(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a whole file."""
    read = lambda at, n: blob[at : at + n]
    head = Head(read)
    parts = [head.block(k, read) for k in range(len(head.blocks))]
    return head.doc_ids, head.lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector, i = vector >> 1, i + 1
    return out


def crc32_joined(first: int, second: int, n: int) -> int:
    """CRC32 of two strings in a row from that of each and the bytes of the second: the first's is moved on over n zero bytes,
    which is a linear map, raised to its power by squaring."""
    zero = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        zero = [_times(zero, x) for x in zero]
    while n:
        if n & 1:
            first = _times(zero, first)
        zero, n = [_times(zero, x) for x in zero], n >> 1
    return first ^ second


def write_ids(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Writes the files into folder (a URI that all executors share); file, n_ids of each, file names in order of doc_id."""
    from pyarrow import fs

    def save(name: str, blob: bytes) -> None:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        hidden = f"{root}/_{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(hidden) as f:
            f.write(blob)
        system.move(hidden, f"{root}/{name}")

    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe, n_file, doc_ids, lengths, held, size = loaded(path), 0, [], [], [], 0
        task = TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            nonlocal n_file, doc_ids, lengths, held, size
            name = f"ids-{task:08d}-{n_file:06d}.rans"
            save(name, dump(doc_ids, np.concatenate(lengths), np.concatenate(held)))
            row = pa.RecordBatch.from_pydict({"file": [name], "task": pa.array([task], pa.int32()), "n_ids": [size], "n_blocks": pa.array([-(-size // BLOCK_IDS)], pa.int32())})
            n_file, doc_ids, lengths, held, size = n_file + 1, [], [], [], 0
            return row

        for batch in batches:
            for part, texts in text_slices(batch):
                ids, offsets = bpe.batch(texts, END_ID)
                doc_ids += part.column(0).to_pylist()
                lengths.append(np.diff(offsets))
                held.append(ids)
                size += len(ids)
                if size >= FILE_IDS:
                    yield close()
        if doc_ids:
            yield close()

    tie = F.xxhash64("text")
    rows = docs.select("doc_id", "text").withColumn("tie", tie)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    return written(ordered.select("doc_id", "text").mapInArrow(run, "file string, task int, n_ids long, n_blocks int"), "files")


_READ = "file string, row long, doc_id long, within long, n_tokens long, first long, n long, crc long"


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files. Tasks read single blocks, each by its place in the file."""
    spark = files.sparkSession
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # ids ahead of a file: those of earlier tasks (a row each), and of the task's earlier files
    tasks = files.groupBy("task").agg(F.sum("n_ids").alias("n"))
    tasks = tasks.select("task", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("task")) - F.col("n")).alias("earlier"))
    own = F.sum("n_ids").over(Window.partitionBy("task").orderBy("file")) - F.col("n_ids")
    starts = files.withColumn("own", own).join(tasks, "task").select("file", (F.col("earlier") + F.col("own")).alias("ahead"))

    schema = _arrow(_READ)

    def work(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        last, head, source = None, None, None
        for batch in batches:
            for name, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != last:
                    source, last = system.open_input_file(f"{root}/{name}"), name
                    read = lambda at, n, f=source: f.read_at(n, at)
                    head = Head(read)
                    end = np.cumsum(head.lengths)
                ids = head.block(k, read)
                lo = k * BLOCK_IDS
                hi = lo + len(ids)
                data = memoryview(ids.astype("<u4").tobytes())
                rows = np.arange(np.searchsorted(end, lo, "right"), min(len(end), np.searchsorted(end, hi, "left") + 1))
                begin = end[rows] - head.lengths[rows]
                first, stop = np.maximum(begin, lo), np.minimum(end[rows], hi)
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((first - lo).tolist(), (stop - lo).tolist(), strict=True)]
                columns = ([name] * len(rows), rows, [head.doc_ids[i] for i in rows.tolist()], begin, head.lengths[rows], first - begin, stop - first, crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    blocks = files.select("file", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    tasks = max(1, -(-(files.agg(F.sum("n_blocks")).first()[0]) // BLOCKS_PER_TASK))  # told by number: rows are too small to tell by size
    rows = written(blocks.repartition(tasks, "file", "block").sortWithinPartitions("file", "block").mapInArrow(work, _READ), "blocks")
    whole = rows.where("n = n_tokens").select("file", "doc_id", "within", "n_tokens", F.col("crc").alias("ids_crc32"))

    def joined(table: pa.Table) -> pa.Table:
        parts = sorted(zip(*(table.column(c).to_pylist() for c in ("first", "n", "crc")), strict=True))
        crc = 0
        for _, n, own in parts:
            crc = crc32_joined(crc, own, 4 * n)
        return table.slice(0, 1).select(["file", "doc_id", "within", "n_tokens"]).append_column("ids_crc32", pa.array([crc], pa.int64()))

    # documents over the border of blocks: a row a block
    cut = rows.where("n < n_tokens").groupBy("file", "row").applyInArrow(joined, "file string, doc_id long, within long, n_tokens long, ids_crc32 long")
    starts = F.broadcast(starts) if files.count() <= MAX_BROADCAST_FILES else starts
    return whole.unionByName(cut).join(starts, "file").select("doc_id", (F.col("ahead") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    folder = new_folder(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, path, folder), folder)
