"""Best-fit packing by bin completion with branch and bound.

A document is its token ids and an end id. One longer than a sequence is cut so that its first piece may be shorter and
all others fill a sequence. How many pieces there are of each length (at most ``capacity`` counts) is all that a plan
needs: bins are patterns of lengths with a multiplicity. The incumbent is best-fit decreasing; unless it meets the lower
bound, bin completion goes on: around the largest length left it enumerates undominated fillings (none that can take one
more piece, or a longer piece for one of its own), least waste first, and prunes where the waste so far leaves no
solution with fewer bins. Four bounds keep the search short: ``NODES`` of it, ``FILLINGS`` taken up at a node (of 40 times as
many found), ``WIDTH`` lengths tried at each place of a filling, and ``DEPTH`` places, after which it is filled greedily. With these the best found stands, which is never worse than best fit; with None for the
first three the search is complete. The bounds don't depend on the data's size, as a plan works on counts of lengths.

Pieces of a length are ranked by counts of buckets of a digest plus a rank in the bucket; a pattern takes ranges of ranks.

Defined cases: null text is empty and has the end id only; repeated rows are packed each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gptids import loaded
from .storage import written
from .textkit import mapped, text_slices

CAPACITY, END_ID = 1024, 2
#: Nodes of the search, fillings tried at a node, and lengths tried at each place of a filling; None: all.
NODES, FILLINGS, WIDTH, DEPTH = 1500, 6, 8, 12

Plan = list[tuple[tuple[int, ...], int]]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def work(batch):
        bpe = loaded(path)
        for part, texts in text_slices(batch):
            ids, offsets = bpe.batch(texts, END_ID)
            data = memoryview(ids.astype("<u4").tobytes())
            n = np.diff(offsets)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            head = n - (count - 1) * capacity
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            at = (offsets[doc] + start) * 4
            crc = [zlib.crc32(data[a : a + 4 * m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            yield {"doc_id": part.column(0).take(pa.array(doc)), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    return mapped(docs.select("doc_id", "text"), work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over lengths with multiplicities."""
    open_: dict[int, Counter] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=capacity)
            per = room // length
            if room in open_ and room != capacity:
                pattern, bins = open_[room].popitem()
                if not open_[room]:
                    del open_[room]
            else:
                pattern, bins = (), -(-left // per)
            full = min(bins, left // per)
            rest = left - full * per if full < bins else 0
            rest = min(rest, per - 1) if per > 1 else 0
            for n, k in ((per, full), (rest, 1 if rest else 0), (0, bins - full - (1 if rest else 0))):
                if k > 0 and (n or pattern):
                    open_.setdefault(room - n * length, Counter())[pattern + (length,) * n] += k
            left -= full * per + rest
    return [(p, k) for r in sorted(open_) for p, k in open_[r].items()]


def fillings(counts: dict[int, int], room: int, lengths: list[int], most: int | None = FILLINGS, width: int | None = WIDTH) -> list[tuple[int, ...]]:
    """Undominated fillings of the room, least waste first. lengths: those in counts, descending."""
    out: set[tuple[int, ...]] = set()
    used: Counter = Counter()
    enough = None if most is None else 40 * most
    below = [-x for x in lengths]

    def fill(at: int, left: int, taken: tuple[int, ...]) -> None:
        at = max(at, bisect.bisect_left(below, -left))
        if width is not None and len(taken) >= DEPTH:  # the rest greedily
            while at < len(lengths):
                n = min(left // lengths[at], counts[lengths[at]] - used[lengths[at]])
                taken += (lengths[at],) * n
                left -= lengths[at] * n
                at = max(at + 1, bisect.bisect_left(below, -left))
            out.add(taken)
            return
        options = list(itertools.islice((i for i in range(at, len(lengths)) if counts[lengths[i]] > used[lengths[i]]), width))
        if not options:
            out.add(taken)
        for i in options:
            if enough is not None and len(out) >= enough:
                return
            used[lengths[i]] += 1
            fill(i, left - lengths[i], taken + (lengths[i],))
            used[lengths[i]] -= 1

    fill(0, room, ())
    order = sorted(out, key=lambda f: (room - sum(f), len(f)))
    best = []
    for f in order:
        waste, own = room - sum(f), Counter(f)
        if not any(counts[z] > own[z] and (z <= waste or any(x < z <= x + waste for x in own)) for z in lengths):
            best.append(f)
            if len(best) == most:
                break
    return best or order[:1]


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES, most: int | None = FILLINGS, width: int | None = WIDTH) -> Plan:
    """Patterns with multiplicities that take every piece; as few bins as found within the bounds, as few as can be with None for all."""
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return []
    total = sum(k * v for k, v in counts.items())
    best = best_fit(counts, capacity)
    n_best = sum(k for _, k in best)
    least = max(-(-total // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
    budget = [math.inf if nodes is None else nodes]

    def search(left: dict[int, int], done: Plan, bins: int, waste: int) -> None:
        nonlocal best, n_best
        if not left:
            if bins < n_best:
                best, n_best = list(done), bins
            return
        budget[0] -= 1
        lengths = sorted(left, reverse=True)
        top = lengths[0]
        own = left | {top: left[top] - 1}
        for f in fillings(own, capacity - top, lengths, most, width):
            if budget[0] <= 0 or n_best <= least:
                return
            bin_ = Counter((top, *f))
            times = min(left[x] // n for x, n in bin_.items()) if nodes is not None else 1
            spilt = waste + times * (capacity - top - sum(f))
            if spilt > (n_best - 1) * capacity - total:
                continue
            rest = {x: n for x, n in ((x, left[x] - times * bin_[x]) for x in left) if n}
            search(rest, [*done, ((top, *f), times)], bins + times, spilt)

    if n_best > least:
        import sys

        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 20_000))
        search(counts, [], 0, 0)
        sys.setrecursionlimit(limit)
    return best


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank 0 .. n - 1 within their length."""
    key = F.md5(F.concat_ws(":", "doc_id", "piece"))
    rows = rows.withColumn("digest", key).withColumn("bucket", F.substring("digest", 1, 3))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("digest", "doc_id", "piece", "ids_crc32"))
    return rows.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + place - 1).drop("digest", "bucket", "before")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    rows = written(pieces(docs, path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    taken: Counter = Counter()
    starts, bases, offsets, base = [], [], [], 0
    for pattern, times in plan(counts, capacity):
        at = 0
        for length in pattern:
            starts.append((length << 44) + taken[length])
            bases.append(base)
            offsets.append(at)
            taken[length] += times
            at += length
        base += times
    order = np.argsort(np.array(starts, np.int64), kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((np.array(starts, np.int64)[order], np.array(bases, np.int64)[order], np.array(offsets, np.int64)[order]))

    def place(batch):
        if not batch.num_rows:
            return
        names = batch.schema.names
        first, base_of, offset_of = shared.value
        key = (batch.column(names.index("length")).to_numpy().astype(np.int64) << 44) + batch.column(names.index("rank")).to_numpy()
        at = np.searchsorted(first, key, "right") - 1
        yield {n: batch.column(names.index(n)) for n in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": base_of[at] + key - first[at], "offset": offset_of[at]}

    return mapped(ranked(rows), place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
