"""Risk-controlled quality rules.

Every document gets counts over its whole text. A rule says "reject where a count per word (or line) is over a cutoff".
Cutoffs come from labelled documents: per stratum (language) and signal, each cutoff of a fixed grid is tested with the
exact binomial tail against "rejects at least ``alpha / number of signals`` of the good documents". The level is
``delta`` divided by all tests made (Bonferroni), so with probability ``1 - delta`` no stratum loses over ``alpha`` of its
good documents, whichever certified cutoff is then chosen. Chosen is the one that catches most bad documents net of good
ones lost, the most lenient at a tie; a stratum with too few labels, or no gain, gets no rule.

A doc_id is one observation, however often its label or its document is repeated: else copies of a few labels would pass
for evidence. Labels that contradict each other say nothing; of a doc_id's rows the least (by stratum and counts) speaks.

Defined cases: a null or empty text has no words and fails the base; null lang is the stratum ``''``; repeated rows are
judged alike, each; labels without a document, or of null doc_id or quality, say nothing; empty tables give empty results;
further columns are left alone (the filter passes them on).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .textkit import interned, mapped, raw, split_words, text_slices, windows

#: Signals, all worse when higher, with the cutoffs tried.
GRIDS = {
    "symbols": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0],
    "dup_lines": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8],
    "repeats": [0.05, 0.08, 0.11, 0.14, 0.17],
    "shouts": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8],
    "capitals": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8],
}
ALPHA, DELTA = 0.05, 0.05
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_capitals"]
WINDOW = 5

_SYMBOL, _CAPITAL = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL[65:91] = True


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier one."""
    lines = [x for x in text.split(b"\n") if x and x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _repeats(ids: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    at, doc = windows(n_words, WINDOW)
    covered = np.zeros(len(ids), bool)
    if len(at):
        key = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(WINDOW):
            key = (key + ids[at + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(29)
        order = np.argsort(key, kind="stable")
        twin = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        a, b = order[twin], order[twin + 1]
        same = doc[a] == doc[b]
        for k in range(WINDOW):
            same &= ids[at[a] + k] == ids[at[b] + k]
        if same.all():
            hit = np.unique(np.concatenate((a, b)))
        else:  # two windows share a key: compare them in full
            seen: dict[tuple, list[int]] = {}
            for w in range(len(at)):
                seen.setdefault((doc[w], *ids[at[w] : at[w] + WINDOW]), []).append(w)
            hit = np.array([w for v in seen.values() if len(v) > 1 for w in v], np.int64)
        for k in range(WINDOW):
            covered[at[hit] + k] = True
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    return np.bincount(text_of[covered], minlength=len(n_words))


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text (no nulls)."""
    data, offsets = raw(texts)
    words, at, _ = split_words(data, offsets)
    n_words = np.diff(at)
    ids, _ = interned(words)

    def total(mark: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mark)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    from .textkit import _SPACE

    lines = np.array([_lines(x) for x in texts.cast(pa.binary()).to_pylist()], np.int64).reshape(-1, 2)
    return {
        "n_words": n_words,
        "word_chars": total(~_SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": total(_SYMBOL[data]),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": _repeats(ids, n_words),
        "n_lines": lines[:, 0],
        "n_shouts": total(data == 33),
        "n_capitals": total(_CAPITAL[data]),
    }


def signals(c: dict) -> dict:
    """Signals from counts; works on arrays and on columns."""
    by = lambda a, b: a / (b + (b == 0)) if isinstance(a, np.ndarray) else a / F.greatest(b, F.lit(1))
    return {"symbols": by(c["n_symbols"], c["n_words"]), "dup_lines": by(c["n_dup_lines"], c["n_lines"]), "repeats": by(c["n_repeat_words"], c["n_words"]), "shouts": by(c["n_shouts"], c["n_words"]), "capitals": by(c["n_capitals"], c["word_chars"])}


def base_failed(c: dict):
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and counts of every row, from whole texts."""

    def work(batch):
        for part, texts in text_slices(batch):
            yield {"doc_id": part.column(0), "stratum": part.column(1), **counts(texts)}

    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "text")
    return mapped(rows, work, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), by the incomplete beta function's continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x >= (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def least_labels(tests: int, alpha: float, delta: float) -> int:
    """Good labelled rows that a stratum needs before even a rule without a false rejection is certified."""
    return math.ceil(math.log(delta / tests) / math.log1p(-alpha))


def calibrate(measures: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and signal. To the driver go counts per stratum and cutoff only, of strata with labels enough."""
    told = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    one = measures.join(told, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("stratum", *COUNTS)).alias("m")).select("quality", "m.*")
    judged = one.where(~base_failed({c: F.col(c) for c in COUNTS}))
    values, good, bad = signals({c: F.col(c) for c in COUNTS}), F.col("quality") == 1, F.col("quality") == 0
    tests = [(s, t) for s, grid in GRIDS.items() for t in grid]
    sums = [F.sum((kind & (values[s] > t)).cast("long")).alias(f"{name}{i}") for i, (s, t) in enumerate(tests) for name, kind in (("good", good), ("bad", bad))]
    n_strata = judged.select("stratum").distinct().count()
    share, level = alpha / len(GRIDS), max(1, n_strata) * len(tests)
    rows = judged.groupBy("stratum").agg(F.sum(good.cast("long")).alias("n"), *sums).where(F.col("n") >= least_labels(level, share, delta)).collect()
    chosen: dict[str, dict[str, float]] = {}
    for r in rows:
        for s in GRIDS:
            best = (0, 0.0)
            for i, (name, t) in enumerate(tests):
                if name == s and binomial_tail(r[f"good{i}"], r["n"], share) <= delta / level:
                    best = max(best, (r[f"bad{i}"] - r[f"good{i}"], t))
            if best[0] > 0:
                chosen.setdefault(r["stratum"], {})[s] = best[1]
    return chosen


def verdict(c: dict, stratum, cutoffs: dict[str, dict[str, float]]):
    """True where a certified rule of the stratum rejects; on columns."""
    v, out = signals(c), F.lit(False)
    for name, rules in sorted(cutoffs.items()):
        own = F.lit(False)
        for s, t in rules.items():
            own = own | (v[s] > t)
        out = F.when(stratum == name, own).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of docs: doc_id, counts, base_failed, rejected (by a certified rule), kept."""
    measures = written(measured(docs), "quality")
    cutoffs = calibrate(measures, labels, alpha, delta)
    c = {x: F.col(x) for x in COUNTS}
    return measures.withColumn("base_failed", base_failed(c)).withColumn("rejected", ~F.col("base_failed") & verdict(c, F.col("stratum"), cutoffs)).withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))


def keep(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that pass, columns unchanged. Counts are taken again in the filtering pass: no text is shuffled."""
    cutoffs = calibrate(written(measured(docs), "quality"), labels, alpha, delta)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch.rename_columns([f"c{i}" for i in range(batch.num_columns)]), f"c{text}"):
                c = counts(texts)
                v, out = signals(c), base_failed(c)
                strata = np.array([x or "" for x in part.column(lang).to_pylist()], object)
                for name, rules in cutoffs.items():
                    own = np.zeros(len(out), bool)
                    for s, t in rules.items():
                        own |= v[s] > t
                    out = out | (own & (strata == name))
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(~out)).columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
