"""The pipeline's stages on odd tables, and the whole of it against plain Python on a small one."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from treeledger.llm import langid, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, label string, kept boolean, text_id long, c0 string"
MORE = (5, "x", True, 9, "c")


def shingles(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of two made-up languages: copies, near copies, junk, nulls, repeated rows, a long text, further columns."""
    random.seed(12)
    words = {"en": [f"th{a}{b}" for a in "aeiou" for b in "ndrstlmk"], "fr": [f"qu{a}{b}é" for a in "aeiou" for b in "xzpgbv"]}
    text = lambda lang, n: " ".join(random.choice(words[lang]) for _ in range(n))
    made = [(i, text(lang, random.randrange(20, 60)), lang, "s") for i, lang in enumerate(random.choices(["en", "fr"], k=240))]
    near = made[3][1].split()
    extra = [(300, None, "en", "s"), (301, "", None, None), (302, "too short", "en", "s"), (303, "### " * 40, "en", "s"), (304, made[0][1], "fr", "s"), (305, made[0][1] + "  ", made[0][2], "s"), (306, made[1][1], made[1][2], "s"), (306, made[1][1], made[1][2], "s"), (307, " ".join([*near[:-1], "changed"]), made[3][2], "s"), (308, text("en", 20_000), "en", "s"), (None, text("en", 30), "en", "s"), (309, text("fr", 30), None, "s"), (310, "12 34 56 78 90 11 12 13 14 15 16", "en", "s")]
    rows = [(*r, len(r[1] or ""), *MORE) for r in made + extra]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(240)] * 2 + [(300, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def table(spark, folder, name="documents"):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain(rows):
    return Counter(tuple(r) for r in rows.collect())


def by_hand(rows, key, best):
    """One row of each group that key names (None: all stay)."""
    groups, out = defaultdict(list), []
    for r in rows:
        k = key(r)
        out.append(r) if k is None else groups[k].append(r)
    return out + [min(g, key=best) for g in groups.values()]


def near_by_hand(rows):
    sets = [shingles(r["text"]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if sets[i] and r["doc_id"] is not None:
            least[root(i)] = min(least.get(root(i), r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(rows) if not sets[i] or r["doc_id"] is None or least[root(i)] == r["doc_id"]]


def test_each_stage(spark, folder):
    docs = table(spark, folder)
    every = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        assert not plain(out) - plain(docs), name  # rows are kept or dropped, never changed
        assert stage(spark, docs.where("false"), folder).count() == 0, name
    good = quality.keep(docs, table(spark, folder, "labels")).collect()
    assert {300, 301, 302, 303}.isdisjoint({r["doc_id"] for r in good}) and len(good) >= 240
    model = langid.trained(docs)
    known = {r["doc_id"]: r for r in langid.identified(docs, model).collect()}
    kept = corpus_pipeline.language(spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(r["doc_id"] for r in every if known[r["doc_id"]]["lang_pred"] != "und" and known[r["doc_id"]]["score"] >= langid.MIN_SCORE)
    bare = lambda r: "".join((r["text"] or "").split())
    want = by_hand(every, bare, lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
    assert plain(corpus_pipeline.exact_dedup(spark, docs, folder)) == Counter(tuple(r) for r in want)
    once = {(r["doc_id"], r["text"]): r for r in near_by_hand(every)}  # rows repeated with one doc_id and text stay once
    assert plain(corpus_pipeline.near_dedup(spark, docs, folder)) == Counter(tuple(r) for r in once.values())
    assert corpus_pipeline.best_fit_packing(spark, docs.where("false"), folder).count() == 0


def test_rows_of_one_doc_id_with_different_texts(spark, folder):
    docs = table(spark, folder)
    three, other = docs.where("doc_id = 3").first(), docs.where("doc_id = 20").first()
    more = [(70_000, three["text"], *list(three)[2:]), (70_000, other["text"] + " and what only this one says at the very end of it", *list(other)[2:])]
    mixed = docs.where("doc_id <> 20 and doc_id <> 307").unionByName(spark.createDataFrame(more, docs.schema))
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, mixed, folder).collect()]
    assert (3, three["text"]) in kept and (70_000, more[1][1]) in kept and (70_000, three["text"]) not in kept


def test_whole_run(spark, folder):
    docs = table(spark, folder)
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, folder)
    left = rows.collect()
    out = corpus_pipeline.run(spark, folder).collect()
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*lib.encode(r["text"], add_special_tokens=False).ids, 2] for r in left}
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter(r["doc_id"] for r in left)
    for r in out:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    filled = defaultdict(list)
    for r in out:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in filled.values():
        v.sort()
        assert sum(n for _, n in v) <= 1024 and [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))]
    assert sum(map(len, ids.values())) == sum(r["length"] for r in out)
