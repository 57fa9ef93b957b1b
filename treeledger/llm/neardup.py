"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct 5-word shingles. Its signature has 64 MinHash symbols of 16 bits. Signatures are split in
16 chunks of 4; two that differ in at most 31 symbols have, by the pigeonhole principle, a chunk with at most one error,
and every chunk is filed under each of its 4 patterns of 3 symbols, which enumerates that error. So all pairs within
distance 31 meet in a bucket (at similarity 0.75 a distance over 31 has probability 2e-5). In a bucket the distance of
4-bit sketches, which never exceeds the signatures', drops the rest; what remains is confirmed on full sets.

Equal sets are one class before anything else, so copies cost nothing. Every class first tries its nearest bucket leader
(the least class of a bucket); buckets that hold over a thousandth of a sample are salted. What the links found leave
apart, though a bucket has them together, is suspect: members of small buckets that are within the distance of another
component's, and all members of mixed larger ones. Among suspects pairs come from their sets' rarest shingles. In one order of all
shingles (frequent ones last), sets of n and m <= n shingles that are similar enough share one of the first n - ceil(3n/4) + 1
of the larger and one of the first m - ceil(6m/7) + 1 of the smaller; sizes, the places of the shared shingle, and the sketches drop more. So texts with a
common passage but too little in common are never paired, however many they are. First each suspect tries its nearest
partners; then every pair left between components is confirmed, and no link between them is lost.

Rows are told apart by doc_id and text. Defined cases: null, empty and wordless texts have no set, are linked with
nothing and stay; texts under 5 words are one shingle; repeated rows are equal sets and get the same component; rows of
one doc_id with different texts are classes each, and kept or not each; a null doc_id is linked with nothing unless its set equals another's;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import written
from .textkit import interned, mapped, raw, release, split_words, text_slices, windows

WORDS, PERCENT = 5, 75
SYMBOLS, CHUNK = 64, 4
DISTANCE = SYMBOLS // CHUNK * 2 - 1
#: Rows of an unfinished bucket that a task holds.
BLOCK = 2048
#: Partners of other components that a suspect tries first.
NEAREST = 2
#: A mixed bucket of more classes is suspect as a whole.
SMALL_BUCKET = 256
#: A shingle that more suspects have is frequent (more where over MAX_FREQUENT would be); a list of more rows is cut into blocks.
FREQUENT, MAX_FREQUENT, LIST = 64, 500_000, 4096
#: A bucket with over this share of the sampled classes (one in SAMPLE) is salted; there are at most 64 / HOT of them.
HOT, SAMPLE, SALTS = 0.001, 16, 64
#: Ids that may be broadcast to pick texts; beyond it the texts are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240817)
_A = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_W = _rng.integers(0, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted 64-bit digests of each text's distinct shingles."""
    data, offsets = raw(texts)
    data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    words, at, _ = split_words(data, offsets)
    n_words = np.diff(at)
    ids, distinct = interned(words)
    code = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)[ids] if len(ids) else np.zeros(0, np.uint64)
    places, _ = windows(n_words, WORDS)
    h = np.zeros(len(places), np.uint64)
    for k in range(WORDS):
        h += code[places + k] * _W[k]
    h = mixed(h)
    cut = np.concatenate(([0], np.cumsum(np.maximum(n_words - WORDS + 1, 0))))
    out = []
    for i, n in enumerate(n_words):
        if n >= WORDS:
            out.append(np.unique(h[cut[i] : cut[i + 1]]))
        elif n:
            few = code[at[i] : at[i + 1]]
            out.append(mixed((few * _W[: len(few)]).sum(keepdims=True) + np.full(1, n, np.uint64) * _W[WORDS]))
        else:
            out.append(h[:0])
    return out


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1 << 14):
        np.minimum(least, (s[i : i + (1 << 14), None] * _A + _B).min(0), out=least)
    return (mixed(least) >> np.uint64(48)).astype(np.uint16)


def text_id(text) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, n_shingles, set_id (digest of the set; null without one) and symbols of every row."""

    def work(batch):
        for part, texts in text_slices(batch):
            sets = shingle_sets(texts)
            yield {"doc_id": part.column(0), "text_id": part.column(2), "n_shingles": [len(s) for s in sets], "set_id": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), "symbols": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())}

    return mapped(docs.select("doc_id", "text", text_id(F.col("text")).alias("text_id")), work, "doc_id long, text_id long, n_shingles long, set_id binary, symbols binary")


_ROW = "key long, salt int, id long, s0 long, s1 long, s2 long, s3 long"
_FOUND = "kind int, a long, b long, d int, key long, s0 long, s1 long, s2 long, s3 long"
TIED, MEMBER, LEADER = range(3)


def sketches(sym: np.ndarray) -> list[np.ndarray]:
    """The low 4 bits of every symbol, 16 symbols a word."""
    out = [np.zeros(len(sym), np.uint64) for _ in range(4)]
    for k in range(SYMBOLS):
        out[k // 16] |= (sym[:, k].astype(np.uint64) & np.uint64(15)) << np.uint64(4 * (k % 16))
    return out


def filed(classes: DataFrame) -> DataFrame:
    """A row for each class and pattern of each chunk: bucket key, id and sketch."""

    def work(batch):
        n = batch.num_rows
        if not n:
            return
        sym = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, SYMBOLS).astype(np.uint64)
        sketch = sketches(sym)
        keys = []
        for c in range(0, SYMBOLS, CHUNK):
            for gone in range(CHUNK):
                h = np.full(n, c * CHUNK + gone + 1, np.uint64)
                for k in range(CHUNK):
                    if k != gone:
                        h = (h << np.uint64(16)) | sym[:, c + k]
                keys.append(mixed(h))
        times = len(keys)
        rep = lambda x: np.tile(x.view(np.int64), times)
        yield {"key": np.concatenate(keys).view(np.int64), "salt": np.full(n * times, -1, np.int32), "id": np.tile(batch.column(0).to_numpy(zero_copy_only=False), times)} | {f"s{i}": rep(sketch[i]) for i in range(4)}

    def sliced(batch):
        for i in range(0, batch.num_rows, 1000):
            yield from work(batch.slice(i, 1000))

    return mapped(classes.select("id", "symbols"), sliced, _ROW)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols of sketches (last axis: 4 words) that differ."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    at = {n: i for i, n in enumerate(batch.schema.names)}
    col = lambda n: batch.column(at[n]).to_numpy(zero_copy_only=False)
    return col("key"), col("salt"), col("id"), np.stack([col(f"s{i}").view(np.uint64) for i in range(4)], 1)


def _found(kind, a, b, d, key, sketch) -> dict:
    n = len(a)
    return {"kind": np.full(n, kind, np.int32), "a": a, "b": b, "d": np.asarray(d, np.int32), "key": key} | {f"s{i}": np.ascontiguousarray(sketch[:, i]).view(np.int64) for i in range(4)}


def _paired(a, b, kind, ids, sketch, keys) -> dict:
    d = differing(sketch[a], sketch[b])
    ok = (d <= DISTANCE) & (ids[a] != ids[b])
    return _found(kind, ids[a[ok]], ids[b[ok]], d[ok], keys[a[ok]], np.zeros((int(ok.sum()), 4), np.uint64))


def bucketed(rows: DataFrame) -> DataFrame:
    """One sweep over buckets in order of key: ties of close members to the least one, the members of buckets of two or more,
    and (salted) leaders."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(_FOUND))

    def batch_of(c: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[f.name], f.type) for f in out], schema=out)

    def run(batches):
        held, opened = None, False  # rows of the unfinished bucket; whether it has begun, then only its least row is held
        for batch in _then_none(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                new = _columns(batch)
                held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new, strict=True))
            if held is None:
                continue
            key, salt, ids, sketch = held
            begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))))
            size = np.diff(np.append(begin, len(key)))
            flush = batch is not None and size[-1] > 4 * BLOCK
            take = len(begin) if batch is None or flush else len(begin) - 1
            several = (size > 1) | (salt[begin] >= 0)
            several[0] |= opened
            member = np.flatnonzero(np.repeat(several[:take], size[:take]))
            if len(member):
                group = np.repeat(np.arange(take), size[:take])
                lead = begin[group[member]]
                star = lead != member
                ties = _paired(lead[star], member[star], TIED, ids, sketch, key)
                yield batch_of(ties)
                # a bucket of two that are not close has nothing more to give
                far = (size[:take] == 2) & (salt[begin[:take]] < 0) & ~np.isin(key[begin[:take]], ties["key"])
                far[0] &= not opened
                fresh = member[~far[group[member]]]
                fresh = fresh[1:] if opened and len(fresh) and fresh[0] == 0 else fresh
                yield batch_of(_found(MEMBER, ids[fresh], ids[fresh], np.zeros(len(fresh)), key[fresh], sketch[fresh]))
                first = begin[:take][salt[begin[:take]] >= 0]
                first = first[1:] if opened and len(first) and first[0] == 0 else first
                yield batch_of(_found(LEADER, ids[first], ids[first], np.zeros(len(first)), key[first], sketch[first]))
            if batch is None:
                break
            start = begin[-1]
            opened = bool(flush) or (opened and len(begin) == 1)
            held = tuple(x[start : start + 1] if flush else x[start:] for x in held)

    return rows.mapInArrow(run, _FOUND)


def _then_none(batches):
    """The batches, then None; memory is given back between them."""
    for batch in batches:
        yield batch
        release()
    yield None


def hot_keys(classes: DataFrame) -> DataFrame:
    """Keys with over HOT of the sampled classes; at most SYMBOLS / HOT rows."""
    sample = classes.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    least = max(8, int(sample.count() * HOT))
    return filed(sample).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key", F.lit(1).alias("hot"))


def _groups(batches, columns: Callable, same: Callable):
    """Arrays of whole groups: the columns of the batches up to the last group that may go on, which is held back."""
    held = None
    for batch in _then_none(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            new = columns(batch)
            held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new, strict=True))
        if held is None:
            continue
        begin = np.flatnonzero(np.concatenate(([True], ~same(held))))
        if batch is None:
            yield held, begin, np.diff(np.append(begin, len(held[0])))
            return
        last = begin[-1]
        if last:
            yield tuple(x[:last] for x in held), begin[:-1], np.diff(begin)
            held = tuple(x[last:] for x in held)


def _squares(begin: np.ndarray, size: np.ndarray, cells: int = 1 << 19):
    """Places of the left and of the right members of all groups of two or more: matrices with a row a group, groups of one size
    together, at most about so many pairs at a time."""
    for k in np.unique(size[size > 1]):
        at = begin[size == k]
        if k * k <= cells:
            step = max(1, cells // int(k * k))
            for lo in range(0, len(at), step):
                own = at[lo : lo + step, None] + np.arange(k)
                yield own, own
        else:
            step = max(1, cells // int(k))
            for one in at:
                for lo in range(0, k, step):
                    yield one + np.arange(lo, min(k, lo + step))[None, :], one + np.arange(k)[None, :]


def suspects(members: DataFrame, labels: DataFrame) -> DataFrame:
    """id of the classes that a bucket has together with a close class of another component. In a bucket of over SMALL_BUCKET
    classes all count as close, so that no bucket is compared all against all."""
    told = members.join(labels, members["a"] == labels["id"], "left").select("key", F.col("a").alias("id"), F.coalesce("label", "a").alias("label"), "s0", "s1", "s2", "s3")
    mixed_keys = told.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    rows = written(told.join(mixed_keys, "key"), "mixed")

    def columns(batch):
        c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
        return (*c[:3], np.stack([x.view(np.uint64) for x in c[3:]], 1))

    def run(batches):
        for (_, ids, of, sketch), begin, size in _groups(batches, columns, lambda h: h[0][1:] == h[0][:-1]):
            found = []
            for left, right in _squares(begin, size):
                close = differing(sketch[left][:, :, None, :], sketch[right][:, None, :, :]) <= DISTANCE
                close &= of[left][:, :, None] != of[right][:, None, :]
                found.append(ids[left[close.any(2)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64))], names=["id"])

    small = rows.where(F.col("n") <= SMALL_BUCKET).select("key", "id", "label", "s0", "s1", "s2", "s3").repartition("key").sortWithinPartitions("key").mapInArrow(run, "id long")
    return small.unionByName(rows.where(F.col("n") > SMALL_BUCKET).select("id")).distinct()


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that very many sets have, sorted, and how many do; at most MAX_FREQUENT."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT, total // MAX_FREQUENT)
    rows = sets.select(F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > least).toArrow()
    shingle, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def prefix_sizes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of its rarest shingles a set of n looks up, and how many of them the larger sets find it by."""
    return n + 1 - -(-PERCENT * n // 100), n + 1 - -(-2 * PERCENT * n // (100 + PERCENT))


_PREFIX = "shingle long, id long, n int, place int, s0 long, s1 long, s2 long, s3 long"


def prefixes(sets: DataFrame) -> DataFrame:
    """A row for each of the rarest shingles of every set (id, set, n, symbols), with its place in the set's order."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent(sets))

    def work(batch):
        common, count = shared.value
        names = batch.schema.names
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            lists = part.column(names.index("set"))
            flat, n = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(common, flat), max(0, len(common) - 1))
            weight = np.where(common[at] == flat, count[at], 0) if len(common) else np.zeros(len(flat), np.int64)
            flat = flat[np.lexsort((flat, weight, doc))]
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            on = np.flatnonzero(place < prefix_sizes(n)[0][doc])
            sym = np.frombuffer(b"".join(part.column(names.index("symbols")).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            sketch = sketches(sym)
            yield {"shingle": flat[on], "id": part.column(names.index("id")).to_numpy(zero_copy_only=False)[doc[on]], "n": n[doc[on]], "place": place[on]} | {f"s{i}": sketch[i][doc[on]].view(np.int64) for i in range(4)}

    return mapped(sets.select("id", "set", "symbols"), work, _PREFIX)


#: Rows of a list that stand for both sides of its pairs, or, where it is cut into blocks, for one of them.
BOTH, LEFT, RIGHT = range(3)


def rare_pairs(rows: DataFrame, labels: DataFrame, nearest: int | None = None) -> DataFrame:
    """Pairs a < b of suspects in different components that share a rarest shingle and may be similar enough; ``nearest``: only so
    many for each suspect, the closest first. In the list of a shingle those for which it is among the first 1/7 (the left side) meet those
    that are as long or longer; a list without the former pairs nobody."""
    looks = F.col("place") < F.col("n") + 1 - F.expr(f"({2 * PERCENT} * n + {100 + PERCENT - 1}) div {100 + PERCENT}")
    lists = rows.groupBy("shingle").agg(F.count("*").alias("n_right"), F.sum(looks.cast("long")).alias("n_left")).where(F.col("n_right") > LIST)
    lists = written(lists.select("shingle", F.ceil(F.col("n_left") / LIST).cast("int").alias("lefts"), F.ceil(F.col("n_right") / LIST).cast("int").alias("rights")), "lists")
    cut = F.broadcast(lists) if lists.count() <= MAX_BROADCAST_IDS else lists
    told = rows.withColumn("looks", looks).join(cut, "shingle", "left").where("lefts is null or lefts > 0")
    told = told.join(labels.withColumnRenamed("id", "labelled"), told["id"] == F.col("labelled"), "left").withColumn("label", F.coalesce("label", "id"))
    # a long list's sides are dealt over blocks, and each two blocks meet in one place
    at = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    mine = lambda of: F.pmod(F.xxhash64("id"), F.col(of))
    right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: at(i, mine("rights"), RIGHT))
    left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: at(mine("lefts"), j, LEFT))
    places = F.when(F.col("lefts").isNull(), F.array(at(F.lit(0), F.lit(0), BOTH))).when(F.col("looks"), F.concat(left, right)).otherwise(right)
    told = told.withColumn("at", F.explode(places)).select("shingle", "at.i", "at.j", "at.side", "id", "label", "n", "place", "s0", "s1", "s2", "s3")

    def columns(batch):
        c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(12)]
        return (*(x.astype(np.int64) for x in c[:8]), np.stack([x.view(np.uint64) for x in c[8:]], 1))

    def same(h):
        return (h[0][1:] == h[0][:-1]) & (h[1][1:] == h[1][:-1]) & (h[2][1:] == h[2][:-1])

    def meetings(leads, follows, begin, size):
        """Matrices of places: the left members and the right ones of the same lists."""
        any_lead = np.add.reduceat(leads.astype(np.int64), begin) > 0
        begin, size = begin[any_lead], size[any_lead]
        yield from _squares(begin[size <= 64], size[size <= 64])
        for lo, n in zip(begin[size > 64].tolist(), size[size > 64].tolist(), strict=True):
            one, two = lo + np.flatnonzero(leads[lo : lo + n]), lo + np.flatnonzero(follows[lo : lo + n])
            step = max(1, (1 << 19) // max(1, len(two)))
            for k in range(0, len(one), step):
                yield one[None, k : k + step], two[None, :]

    def run(batches):
        for (_, _, _, side, ids, of, n, place, sketch), begin, size in _groups(batches, columns, same):
            leads, follows = (place < prefix_sizes(n)[1]) & (side != RIGHT), side != LEFT
            found = []
            for left_at, right_at in meetings(leads, follows, begin, size):
                a, b = left_at[:, :, None], right_at[:, None, :]
                fits = leads[a] & follows[b] & (of[a] != of[b]) & (n[a] <= n[b]) & (100 * n[a] >= PERCENT * n[b])
                fits &= np.minimum(n[a] - place[a], n[b] - place[b]) * (100 + PERCENT) >= PERCENT * (n[a] + n[b])
                g, x, y = np.nonzero(fits)
                p, q = left_at[g, x], right_at[g, y]
                d = differing(sketch[p], sketch[q])
                ok = d <= DISTANCE
                p, q, d = p[ok], q[ok], d[ok]
                if nearest is not None:
                    p, q, d = np.concatenate((p, q)), np.concatenate((q, p)), np.tile(d, 2)
                    order = np.lexsort((ids[q], d, p))
                    p, q, d = p[order], q[order], d[order]
                    rank = np.arange(len(p)) - np.searchsorted(p, p)
                    p, q, d = p[rank < nearest], q[rank < nearest], d[rank < nearest]
                found.append((np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]), d))
            if found:
                pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2].astype(np.int32))], names=["a", "b", "d"])

    pairs = told.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j").mapInArrow(run, "a long, b long, d int").distinct()
    if nearest is None:
        return pairs.select("a", "b")
    each = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    each = each.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("place") <= nearest)
    return each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def set_table(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id, set, n of the given classes (id, text_id: a doc_id and its text). The texts are read again; sets of all are never kept."""
    ids = written(ids.distinct(), "ids")
    named = docs.select("doc_id", "text", text_id(F.col("text")).alias("text_id"))
    texts = named.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, (named["doc_id"] == ids["id"]) & (named["text_id"] == ids["text_id"])).select("id", "text")

    def work(batch):
        for part, text in text_slices(batch):
            sets = shingle_sets(text)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield {"id": part.column(0), "set": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))}

    return written(mapped(texts, work, "id long, set array<bigint>"), "sets").where("size(set) > 0").select("id", "set", F.size("set").cast("long").alias("n"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough, as edges u, v."""
    one, two = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
    return rows.where(100 * F.col("shared") >= PERCENT * (F.col("total") - F.col("shared"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, n_shingles, component_id, kept of every row."""
    rows = written(signed(docs), "signatures")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_id"))).alias("m")
    classes = written(rows.where("set_id is not null").groupBy("set_id").agg(first, F.first("symbols").alias("symbols")).where("m is not null").select("set_id", F.col("m.doc_id").alias("id"), F.col("m.text_id").alias("text_id"), "symbols"), "classes")
    hot = written(hot_keys(classes), "hot")
    salted = filed(classes).join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1))).drop("hot")
    order = ("key", "salt", "id")
    found = written(bucketed(salted.select("key", "salt", "id", "s0", "s1", "s2", "s3").repartition("key", "salt").sortWithinPartitions(*order)), "buckets")
    leaders = found.where(f"kind = {LEADER}").select("key", F.lit(-1).alias("salt"), F.col("a").alias("id"), "s0", "s1", "s2", "s3")
    over = written(bucketed(leaders.repartition("key").sortWithinPartitions(*order)), "buckets").where(f"kind = {TIED}")
    ties = found.where(f"kind = {TIED}").unionByName(over)
    tried = written(ties.groupBy("b").agg(F.min(F.struct("d", "a")).alias("x")).select(F.col("x.a").alias("a"), "b"), "pairs")
    named = classes.select("id", "text_id")
    of = lambda ids: named.join(ids, "id", "left_semi")
    edges = confirmed(tried, set_table(of(tried.select(F.col("a").alias("id")).unionByName(tried.select(F.col("b").alias("id")))), docs))
    labels = written(components(edges), "labels")
    both = lambda more: written(components(labels.select(F.col("id").alias("u"), F.col("label").alias("v")).unionByName(more)), "labels")
    apart = written(suspects(found.where(f"kind = {MEMBER}").select("key", "a", "s0", "s1", "s2", "s3"), labels), "suspects")
    if not apart.isEmpty():
        sets = set_table(of(apart), docs)
        rare = written(prefixes(sets.join(classes.select("id", "symbols"), "id")), "rare")
        near = written(rare_pairs(rare, labels, NEAREST).join(tried, ["a", "b"], "left_anti"), "pairs")
        labels = both(confirmed(near, sets))
        rest = rare_pairs(rare, labels).join(tried, ["a", "b"], "left_anti").join(near, ["a", "b"], "left_anti")
        labels = both(confirmed(rest, sets))
    component = classes.join(labels, "id", "left").select("set_id", F.coalesce("label", "id").alias("component"))
    out = rows.join(component, "set_id", "left").select("doc_id", "text_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return judged(docs).drop("text_id")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is its component's, columns unchanged; of rows repeated with that doc_id and text one stays.

    Rows dropped are named by doc_id and text; broadcast where they are few enough, joined otherwise.
    """
    told = written(judged(docs), "judged")
    gone = written(told.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_id").alias("gone_text")).distinct(), "gone")
    again = written(told.where("kept and n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("gone_id"), F.col("text_id").alias("gone_text")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    few = gone.count() <= MAX_BROADCAST_IDS and again.count() <= MAX_BROADCAST_IDS
    hint = F.broadcast if few else (lambda x: x)
    names = docs.columns
    whole = [f"c{i}" for i in range(len(names))]
    doc_id, text = (whole[names.index(x)] for x in ("doc_id", "text"))
    rows = docs.toDF(*whole).withColumn("text_id", text_id(F.col(text)))
    named = (F.col(doc_id) == F.col("gone_id")) & (F.col("text_id") == F.col("gone_text"))
    left = rows.join(hint(gone), named, "left_anti")
    if again.isEmpty():
        return left.select(*whole).toDF(*names)
    once = left.join(hint(again), named, "left_anti")
    several = left.join(hint(again), named, "left_semi").dropDuplicates([doc_id, "text_id"])
    return once.unionByName(several).select(*whole).toDF(*names)
