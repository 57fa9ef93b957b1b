"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 lower-cased characters are hashed to 2^15 features; a value is ``log1p(count) * idf``, each document's
vector scaled to length 1. Document frequencies are counted over every learning row. Weights are learned online by
follow-the-regularised-leader (per-coordinate rates, L1 and L2) on a bounded sample: at most ``PER_LANG`` documents of a
language (fewer with more than ``MAX_ROWS / PER_LANG`` languages), chosen by a digest of doc_id, of up to ``MAX_CHARS``
characters. A language that has too few such gets longer ones too, ``MAX_LONG`` over all languages; these come as counts of features, made
of the whole text where it lies. Only the ``MAX_LANGS`` languages with most learning rows are learned, which bounds the model.
A fifth of the sample is kept from training and sets the temperature that divides the logits.

Learning rows are those with text and lang whose crc32(doc_id as text) mod 3 is not 1. A prediction sees the text alone.

Defined cases: null text, or one without a letter, is ``und`` with score 0, as is everything where nothing can be learned;
a null doc_id is neither learned from nor held out; repeated rows are predicted each; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import mapped, text_slices

FEATURES, ORDERS = 1 << 15, 3
PER_LANG, MAX_ROWS, MAX_CHARS, MAX_LONG, MAX_LANGS = 800, 16_000, 8_000, 256, 512
#: FTRL: learning rate, its offset, L1, L2; passes over the sample.
RATE, OFFSET, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.02, 2
#: Below this score the filter doesn't trust a prediction.
MIN_SCORE = 0.5

_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def gram_features(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the hashed n-gram that starts at every character, and the offsets of the texts in characters."""
    low = pc.utf8_lower(texts)
    offsets = np.concatenate(([0], np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False)))).astype(np.int64)
    chars = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le"), np.uint32)
    out, h = [], np.zeros(len(chars), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(ORDERS):
            m = max(0, len(chars) - n)
            h = (h[:m] ^ chars[n : n + m]) * _MIX[n]
            h ^= h >> np.uint32(15)
            out.append((h * np.uint32(0x27D4EB2F)) >> np.uint32(17))
    return out, offsets


def counted(grams: list[np.ndarray], lo: int, hi: int) -> np.ndarray:
    return np.bincount(np.concatenate([g[lo : max(lo, hi - n)] for n, g in enumerate(grams)]), minlength=FEATURES)


def vector(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(count)
    value = np.log1p(count[at]) * idf[at]
    return at, value / (np.sqrt(value @ value) or 1.0)


class Model:
    """langs, idf, weights (features x langs) and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float) -> None:
        self.langs, self.idf, self.weights, self.temperature = langs, idf.astype(np.float32), weights.astype(np.float32), temperature

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of every text (no nulls)."""
        grams, offsets = gram_features(texts)
        names, scores = [], np.zeros(len(texts))
        for i, text in enumerate(texts.to_pylist()):
            if not self.langs or not any(map(str.isalpha, text)):
                names.append("und")
                continue
            at, value = vector(counted(grams, offsets[i], offsets[i + 1]), self.idf)
            p = _softmax(value @ self.weights[at] / self.temperature)
            names.append(self.langs[int(p.argmax())])
            scores[i] = min(1.0, float(p.max()))
        return names, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], target: list[int], n_langs: int) -> np.ndarray:
    z, n = np.zeros((FEATURES, n_langs)), np.zeros((FEATURES, n_langs))
    weight = lambda z, n: np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((OFFSET + np.sqrt(n)) / RATE + L2), 0.0)
    for _ in range(PASSES):
        for (at, value), k in zip(rows, target, strict=True):
            za, na = z[at], n[at]
            w = weight(za, na)
            error = _softmax(value @ w)
            error[k] -= 1
            g = value[:, None] * error
            grown = na + g * g
            z[at], n[at] = za + g - (np.sqrt(grown) - np.sqrt(na)) / RATE * w, grown
    return weight(z, n)


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden section on its logarithm."""

    def loss(t: float) -> float:
        z = logits / math.exp(t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), target]).mean())

    lo, hi, g = -4.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def learning(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and text is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 != 1").select("doc_id", "text", "lang")


def trained(docs: DataFrame) -> Model:
    spark, rows = docs.sparkSession, learning(docs)
    short = F.length("text") <= MAX_CHARS
    per = {r["lang"]: (r["n"], r["n_short"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(short.cast("long")).alias("n_short")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not per:
        return Model([], np.ones(FEATURES), np.zeros((FEATURES, 0)), 1.0)

    def frequencies(batches):
        total = np.zeros(FEATURES, np.int64)
        n = 0
        for batch in batches:
            for part, texts in text_slices(batch):
                grams, offsets = gram_features(texts)
                for i in range(len(texts)):
                    total += counted(grams, offsets[i], offsets[i + 1]) > 0
                n += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n))], names=["feature", "n"])

    df = np.zeros(FEATURES)
    n_docs = 0
    for r in rows.select("text").mapInArrow(frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if r["feature"] < 0:
            n_docs = r["n"]
        else:
            df[r["feature"]] = r["n"]
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    langs = sorted(per)
    want = max(1, min(PER_LANG, MAX_ROWS // len(langs)))
    few = {k: min(n - m, want - m) for k, (n, m) in per.items() if m < want and n > m}
    lengthy = max(1, MAX_LONG // max(1, len(few)))
    share = spark.createDataFrame([(k, min(1.0, want / m) if m else 0.0, min(1.0, min(few.get(k, 0), lengthy) / max(1, n - m))) for k, (n, m) in per.items()], "lang string, share double, long_share double")
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(F.broadcast(share), "lang").withColumn("mark", mark)
    order = F.xxhash64("doc_id", "text")
    got = drawn.where(short & (F.col("mark") < F.col("share"))).orderBy(order).limit(MAX_ROWS + PER_LANG).select("lang", "text").toArrow().combine_chunks()
    vectors, target = [], [langs.index(x) for x in got.column("lang").to_pylist()]
    for batch in got.to_batches():
        for _, texts in text_slices(batch):
            grams, offsets = gram_features(texts)
            vectors += [vector(counted(grams, offsets[i], offsets[i + 1]), idf) for i in range(len(texts))]

    def features(batch):
        for part, texts in text_slices(batch):
            grams, offsets = gram_features(texts)
            found = [counted(grams, offsets[i], offsets[i + 1]) for i in range(len(texts))]
            at = [np.flatnonzero(c) for c in found]
            yield {"lang": part.column(0), "at": [a.tolist() for a in at], "n": [c[a].tolist() for c, a in zip(found, at, strict=True)]}

    if few:
        long_rows = drawn.where(~short & (F.col("mark") < F.col("long_share"))).orderBy(order).limit(2 * MAX_LONG).select("lang", "text")
        for r in mapped(long_rows, features, "lang string, at array<int>, n array<long>").collect():
            count = np.zeros(FEATURES, np.int64)
            count[r["at"]] = r["n"]
            vectors.append(vector(count, idf))
            target.append(langs.index(r["lang"]))
    held = [i for i in range(len(target)) if i % 5 == 4]
    fit = [i for i in range(len(target)) if i % 5 != 4]
    weights = ftrl([vectors[i] for i in fit], [target[i] for i in fit], len(langs))
    t = temperature(np.array([vectors[i][1] @ weights[vectors[i][0]] for i in held]), np.array([target[i] for i in held])) if held and len(langs) > 1 else 1.0
    return Model(langs, idf, weights, t)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        for part, texts in text_slices(batch):
            names, scores = shared.value.predict(texts)
            yield {"doc_id": part.column(0), "held_out": part.column(1), "lang_pred": names, "score": scores}

    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), F.lit(False))
    return mapped(docs.select("doc_id", held.alias("held_out"), "text"), work, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose language is known well enough, columns unchanged."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch.rename_columns([f"c{i}" for i in range(batch.num_columns)]), f"c{at}"):
                names, scores = shared.value.predict(texts)
                good = np.array([x != "und" for x in names], bool) & (scores >= min_score)
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(good)).columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
