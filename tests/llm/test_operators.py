"""Every operator against brute force, with nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from treeledger.llm import bpe, chat, exactdup, langid, neardup, packing, presplit, quality, rans, sharding, urlrules

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, fp long, key string, label long, size long"


@pytest.fixture(scope="module")
def rows(sf):
    import pyarrow.parquet as pq

    own = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()[:60]]
    base = own[0][1]
    words = own[1][1].split()
    odd = [(900, None, "en", "s"), (901, "", None, None), (902, " \t\n", "en", "s"), (903, "12 34 !!", "en", "s"), (904, base, "fr", "s"), (904, base, "fr", "s"), (905, base + "  ", "fr", "s"), (906, " ".join(words[:-1] + ["changed"]), "en", "s"), (907, "one two", "en", "s"), (908, "ONE Two", "en", "s"), (909, "中文 и ещё <|endoftext|> 'sx don't 😀", "en", "s"), (910, base * 40, "fr", "s"), (None, "no id", "en", "s")]
    return own + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(text):
    return (text or "").translate({c: None for c in [32, *range(9, 14)]})


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_quality_counts(docs, rows, empty):
    got = defaultdict(list)
    for r in quality.measured(docs).collect():
        got[r["doc_id"]].append(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))
    for doc_id, text, *_ in rows:
        w = words_of(text)
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert want in got[doc_id]
    assert quality.measured(empty).count() == 0


def test_quality_cutoffs_hold_their_risk(spark):
    random.seed(4)
    made = [(i, "en" if i % 2 else "de", 100, 500, (random.randrange(70, 100) if i % 10 == 0 else random.randrange(0, 25)), 0, 0, 5, 0, 0) for i in range(8000)]
    measures = spark.createDataFrame(made, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(8000)] + [(99999, 1)], "doc_id long, quality int")
    got = quality.calibrate(measures, labels)
    assert set(got) == {"de"} or set(got) == {"en", "de"}
    assert all(0.25 <= c["symbols"] < 0.7 for c in got.values() if "symbols" in c)
    exact = lambda k, n, p: sum(__import__("math").comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, p in ((0, 5, 0.1), (3, 40, 0.05), (10, 30, 0.5), (29, 30, 0.9)):
        assert abs(quality.binomial_tail(k, n, p) - exact(k, n, p)) < 1e-10


def test_repeated_labels_are_one_observation(spark):
    made = [(i, "en", 100, 500, 60 if i >= 9 else 0, 0, 0, 5, 0, 0) for i in range(40)]
    measures = spark.createDataFrame(made, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    labels = [(i, int(i < 9)) for i in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    assert quality.calibrate(measures, frame(labels)) == {} == quality.calibrate(measures, frame(labels * 200))
    assert quality.calibrate(measures.unionByName(measures.where("doc_id < 9")).crossJoin(spark.range(100)).drop("id"), frame(labels)) == {}
    many = spark.createDataFrame([(i, "en", 100, 500, 60 if i % 10 == 0 else 0, 0, 0, 5, 0, 0) for i in range(6000)], measures.schema)
    told = [(i, int(i % 10 > 0)) for i in range(6000)]
    assert "symbols" in quality.calibrate(many, frame(told))["en"]
    assert quality.calibrate(many, frame(told + [(i, 1 - q) for i, q in told] + [(None, 1)])) == {}  # every label is contradicted


def test_quality_filter_keeps_columns(spark, docs, rows):
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and all(len(words_of(r["text"])) >= 10 for r in kept.collect())


def test_shards(docs, rows, empty):
    got = sharding.interleaved(docs, 5).collect()
    assert len(got) == len(rows)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    mixture = Counter((r["source"], r["shard"]) for r in got)
    n = Counter(r[3] or "" for r in rows)
    assert all(abs(mixture[x, s] - n[x] / 5) < 2 for x in n for s in range(5))
    assert sharding.interleaved(empty).count() == 0


@pytest.mark.parametrize("max_paths", [1 << 16, 1])
def test_urls(spark, max_paths):
    rules = [("com", "/en/", "block"), ("A.com", "/en/7", "allow"), ("a.com", "/", "block"), ("b.a.com", "/en/7", "block"), ("b.a.com", "/en/7", "allow"), ("net", "", "block"), ("b.a.com", "/en/78", "allow"), ("com", "/en", "allow")]
    silent = [(None, "/", "block"), ("org", None, "block"), ("com", "/", None), ("", "/", "block")]
    random.seed(2)
    hosts = ["com", "a.com", "b.a.com", "x.b.a.com", "ba.com", "NET", "x.net", "", "a.com:80", "a..com", "q.org"]
    urls = [None, "nothing", "://", "http://a.com", "http://A.com/en/7?x", "x://com/en/#y://b.a.com/en/7"] + [f"http://{random.choice(hosts)}{random.choice(['', '/', '/en/', '/en/7', '/en/78/x', '/de/'])}{random.choice(['', '?q=/en/', '#f'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i % 390, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, part int")

    def want(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in [*rules, ("org", "", "block")] if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        return host, path, *((max(fits)[3:]) if fits else (None, "allow"))

    table = spark.createDataFrame(rules + silent, "host string, path string, verdict string")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.url_filter(pages, table, max_paths=max_paths).collect())
    assert got == Counter((i % 390, *want(u)) for i, u in enumerate(urls))
    assert urlrules.url_filter(pages.where("false"), table).count() == 0
    assert {r["verdict"] for r in urlrules.url_filter(pages, table.where("false")).collect()} == {"allow"}


def test_language(docs, empty, sf, spark):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.trained(table)
    got = langid.identified(table, model).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    odd = {r["doc_id"]: r for r in langid.identified(docs, model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (900, 901, 902, 903))
    assert all(0 <= r["score"] <= 1 for r in odd.values()) and not odd[None]["held_out"]
    assert {r["lang_pred"] for r in langid.identified(docs, langid.trained(empty)).collect()} == {"und"}
    assert (model.weights == 0).mean() > 0.3  # sparse
    assert langid.keep(docs, model).columns == docs.columns


def test_a_language_of_long_texts_only_is_learned(spark):
    random.seed(11)
    words = {"en": ["the", "and", "with", "house"], "fr": ["où", "être", "quelle", "çà"]}
    text = lambda lang, n: " ".join(random.choice(words[lang]) for _ in range(n))
    made = [(i, text("en", 50), "en") for i in range(60)] + [(100 + i, text("fr", 3000), "fr") for i in range(30)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = langid.trained(table)
    assert model.langs == ["en", "fr"]
    got = langid.identified(table, model).collect()
    assert np.mean([r["lang_pred"] == ("fr" if r["doc_id"] >= 100 else "en") for r in got]) > 0.95
    assert langid.identified(table.where("false"), model).count() == 0 and langid.keep(table.where("false"), model).count() == 0


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_automaton(docs, rows, empty):
    lib, sha = library(WORDS), lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((i, len(e := lib.encode(t or "", add_special_tokens=False).ids), sha(" ".join(map(str, e))), sha(lib.decode(e, skip_special_tokens=False))) for i, t, *_ in rows)
    assert Counter(map(tuple, bpe.digests(docs, WORDS).collect())) == want
    assert bpe.digests(empty, WORDS).count() == 0


MERGES = [("a", "a"), ("b", "a"), ("aa", "a"), ("aa", "ba"), ("b", "aa"), ("c", "c"), ("aaba", "cc"), ("cc", "b"), ("a", "baa")]


def written_out(base, merges):
    """The automaton by the letter: every state with all its arcs."""
    states = [dict.fromkeys(base, 0)]
    for a, b in merges:
        p = next((q[a] for q in states if a in q), None)
        if p is None or b not in states[p]:
            continue
        r = states[p][b]
        states.append({x: q for x, q in states[p].items() if x != b})
        for q in states:
            if a in q:
                q[a] = len(states) - 1
                q[a + b] = r
    return states


def test_gadgets_on_a_small_alphabet():
    ids = {s: i for i, s in enumerate(["a", "b", "c", *(x + y for x, y in MERGES)])}
    auto = bpe.MergeAutomaton(ids, MERGES)
    rank = {m: i for i, m in enumerate(MERGES)}
    states = written_out("abc", MERGES)
    assert auto.states == len(states) and len(auto.row) < auto.states  # some states are left behind by later splits
    for q in {0, *auto.target.values()}:
        assert {x: r for x, i in ids.items() if i in auto.target and (r := auto.step(q, i)) is not None} == states[q]

    def slow(w):
        s = list(w)
        while (best := min(((rank[p], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in rank), default=None)) is not None:
            s[best[1] : best[1] + 2] = ["".join(s[best[1] : best[1] + 2])]
        return s

    for n in range(3**8):
        w = "".join("abc"[n // 3**k % 3] for k in range(8))
        labels = auto.encode(w)
        assert auto.decode(labels) == slow(w)
        q = 0
        for x in labels:  # the labels are a path of the table
            q = auto.step(q, x)
        assert q is not None


def test_automaton_of_the_vocabulary():
    auto, lib = bpe.compiled(WORDS), library(WORDS)
    assert auto.states == 1 + sum(len(x) for x in auto._splits.values()) > 40_000 and len(auto.row) < auto.states
    assert len(auto.bounds) < 2_000_000 and all(auto.row[q] <= auto.row_end[q] <= len(auto.bounds) for q in auto.row)
    random.seed(9)
    tables, byte = bpe.ByteTables(auto), {c: b for b, c in enumerate(bpe.byte_alphabet())}
    texts = [n.removesuffix("</w>") for i, n in auto.names.items() if not n.startswith("<|")]
    for _ in range(3000):
        w = "".join(random.choice(texts) for _ in range(random.randint(1, 4)))
        ids = auto.encode(w)
        assert ids == [t.id for t in lib.model.tokenize(w)]
        q = 0
        for x in ids:
            assert (q := auto.step(q, x)) is not None
        if len(w) <= tables.WIDTH:
            assert tables.encode([bytes(byte[c] for c in w)] * 2) == [ids, ids]
    assert tables.encode([]) == []


def test_presplit_covers_the_text():
    lib = library(BYTES)
    table = {i: ord(c) for i, c in enumerate(bpe.byte_alphabet())}
    random.seed(3)
    bits = ["a", "é", "'s", "'", " ", "  ", "\n", "1", "²", "!", "“", "¡", "ß", "\xa0", "x'll", "\u2028", "–"]
    texts = ["".join(random.choice(bits) for _ in range(random.randrange(14))) for _ in range(4000)]
    fast = pa.array(texts).filter(pa.array(~presplit.odd(pa.array(texts), [])))
    pieces, at = presplit.gpt_pieces(fast)
    pieces = pieces.to_pylist()
    assert len(fast) > 500
    for i, t in enumerate(fast.to_pylist()):
        assert [w.decode("latin-1").translate(table) for w in pieces[at[i] : at[i + 1]]] == [w for w, _ in lib.pre_tokenizer.pre_tokenize_str(t)]


def test_chat(spark):
    turns = [(1, k, random.Random(k).choice(["user", "assistant"]), f"say {k} </turn> \\ ### x: <") for k in range(150)] + [(2, 0, "user", None), (2, 0, "assistant", "hi"), (2, None, "a:b\\", "first"), (3, 0, None, "x"), (3, 0, None, "x"), (None, 1, "assistant", "")]
    table = spark.createDataFrame([(*t, "c") for t in turns], "conv_id long, turn long, role string, text string, chunk string")
    by = defaultdict(list)
    for c, k, role, text in turns:
        by[c].append((k is not None, k or 0, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(table)).collect()}
    assert set(got) == set(by)
    for c, v in by.items():
        v.sort()
        loss = "".join(t for *_, r, t in v if r == "assistant")
        assert got[c]["n_turns"] == len(v) and got[c]["loss_chars"] == len(loss)
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in v).encode()).hexdigest()
    assert chat.digests(chat.formatted(table.where("false"))).count() == 0


def test_templates_are_black_boxes():
    plain_ = lambda turns: "<s>" + "".join(f"[{r}]{t}\n" for r, t in turns)
    text, spans, mask, rewritten = chat.located([("user", "q"), ("assistant", "a\n"), ("assistant", "")], plain_)
    assert not rewritten and [text[a:b] for a, b in mask] == ["a\n", ""] and [text[a:b] for a, b in spans[1:]] == ["[assistant]a\n\n", "[assistant]\n"]
    last_only = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else '…'}" for i, (r, t) in enumerate(turns))
    assert chat.located([("user", "long"), ("assistant", "x")], last_only)[3]


def _tail(turns, most=30):
    """Forgets the oldest turns of a long conversation."""
    return "<s>" + "".join(f"[{r}]{t}\n" for r, t in turns[-most:])


def _numbered(turns):
    return "".join(f"{i}[{r}]{t}\n" for i, (r, t) in enumerate(turns))


_numbered.context = 2


def _bos(turns):
    return "<s>" + "".join(f"[{r}]{t}\n" for r, t in turns)


_bos.context = 3


def test_rewritten_history_is_seen_far_back(spark):
    turns = [("user" if k % 2 else "assistant", f"say {k}") for k in range(200)]
    table = spark.createDataFrame([(c, k, *t) for c, n in ((1, 40), (2, 30), (3, 200)) for k, t in enumerate(turns[:n])], "conv_id long, turn long, role string, text string")
    marked = lambda template: {r["conv_id"] for r in chat.formatted(table, template).collect() if r["rewritten"]}
    assert marked(_tail) == {1, 3}  # states no context: whole prefixes
    assert marked(_numbered) == {1, 2, 3}  # states a context that isn't true
    assert marked(_bos) == set() and marked(lambda turns: _bos(turns)) == set()
    for template in (_bos, lambda turns: _bos(turns)):
        got = chat.formatted(table, template).where("conv_id = 3").orderBy("stretch", "chunk").collect()
        assert "".join(r["formatted"] for r in got) == _bos(turns)
        assert [r["formatted"][m["start"] : m["end"]] for r in got for m in r["mask"]] == [t for r, t in turns if r == "assistant"]
        assert sum(len(r["spans"]) for r in got) == 200


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[plain(t)].append((-len(t or ""), i))
    for r in exactdup.exact_duplicates(docs).where("doc_id is not null").collect():
        text = next(k for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        best = min(groups[text])
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best[1], len(groups[text]), r["doc_id"] == best[1])
    kept = exactdup.keep(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exactdup.exact_duplicates(empty).count() == 0 and exactdup.keep(empty).count() == 0


def test_least_doc_id_and_null_ids(spark):
    low = -(1 << 63)
    made = [(low, "same text"), (5, "sametext"), (7, "same  text"), (None, "alone"), (None, "tie"), (3, "tie")]
    table = spark.createDataFrame(made, "doc_id long, text string")
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in exactdup.exact_duplicates(table).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[low, sha("sametext")] == (7, 3, False) and got[7, sha("sametext")] == (7, 3, True)
    assert got[None, sha("tie")] == (3, 2, False) and got[None, sha("alone")] == (None, 1, True)
    table = spark.createDataFrame([(low, "a"), (0, "a")], "doc_id long, text string")
    assert {r["doc_id"] for r in exactdup.keep(table).collect()} == {low}


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 60, 500, dtype=np.uint64) for _ in range(4)]
    parts[1][:200] = parts[0][:200]
    made = [exactdup.CountingQuotientFilter.load(exactdup.CountingQuotientFilter.of(*np.unique(p, return_counts=True), 60).dump()) for p in parts]
    none = exactdup.CountingQuotientFilter.of(np.zeros(0, np.uint64), np.zeros(0, np.int64), 60)
    whole = exactdup.CountingQuotientFilter.merged([*made, exactdup.CountingQuotientFilter.load(none.dump())])
    assert (np.diff(whole.values().astype(object)) > 0).all()
    assert dict(zip(whole.values().tolist(), whole.counts.tolist(), strict=True)) == Counter(np.concatenate(parts).tolist())


def test_near_dedup(spark, sf, docs, rows, empty):
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [random.choice(vocabulary) for _ in range(160)]
    made = []
    for i in range(60):  # a family of copies that drift, so that links form chains
        for _ in range(random.randrange(4)):
            base[random.randrange(160)] = random.choice(vocabulary)
        made.append((2000 + i, " ".join(base)))
    every = [(i, t) for i, t, *_ in rows if i is not None] + made
    table = spark.createDataFrame(every, "doc_id long, text string").repartition(4)
    sets = {}
    for i, t in every:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
    assert sorted(r["doc_id"] for r in neardup.keep(table).collect()) == sorted(i for i in sets if root(i) == i)
    assert neardup.near_duplicates(empty).count() == 0


def test_links_at_all_similarities_around_the_threshold(spark, monkeypatch):
    """Groups with a common passage whose members differ by much, little and just enough; small limits so that lists are cut and buckets are large."""
    monkeypatch.setattr(neardup, "LIST", 8)
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 6)
    monkeypatch.setattr(neardup, "FREQUENT", 4)
    random.seed(13)
    fresh = iter(range(10**9))
    made = []
    for g, own in enumerate((60, 45, 36, 30, 28, 26, 24, 22, 20, 16, 12)):
        passage = [f"p{g}x{k}" for k in range(150)]
        for _ in range(14):
            made.append((len(made), " ".join(passage + [f"w{next(fresh)}" for _ in range(own + random.randrange(-2, 3))])))
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in made}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    roots = {i: root(i) for i in sets}
    assert 20 < len(set(roots.values())) < 130
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect()}
    assert got == roots


def test_texts_with_a_common_passage_are_not_paired(spark):
    """The pairs looked at do not grow with the square of a group that shares a passage but isn't similar enough."""
    def pairs(m):
        passage, fresh = " ".join(f"p{k}" for k in range(140)), iter(range(10**9))
        made = [(i, passage + " " + " ".join(f"w{next(fresh)}" for _ in range(45))) for i in range(m)]
        docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
        signs = neardup.signed(docs)
        sets = neardup.set_table(signs.select(neardup.F.col("doc_id").alias("id"), "text_id"), docs).join(signs.select(neardup.F.col("doc_id").alias("id"), "symbols"), "id")
        none = spark.createDataFrame([], "id long, label long")
        rows = neardup.prefixes(sets)
        lists = defaultdict(lambda: [0, 0])
        for r in rows.collect():
            lists[r["shingle"]][0] += int(r["place"] < neardup.prefix_sizes(r["n"])[1])
            lists[r["shingle"]][1] += 1
        return neardup.rare_pairs(rows, none).count(), sum(a * b for a, b in lists.values())

    for m in (150, 600):
        found, met = pairs(m)
        assert found == 0 and met <= 30 * m


@pytest.mark.parametrize("per_task", [8, 1000])
def test_components(spark, per_task):
    from treeledger.llm.components import components

    random.seed(8)
    pairs = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7)]
    label = {i: i for p in pairs for i in p}
    for _ in range(60):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(pairs, "u long, v long"), per_task).collect()}
    assert got == {i: label[i] for i in linked}


def test_pigeonhole_finds_every_pair_within_the_distance():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, neardup.SYMBOLS)
        b = a.copy()
        for k in rng.choice(neardup.SYMBOLS, neardup.DISTANCE, replace=False):
            b[k] ^= 1 + rng.integers(0, 1 << 10)
        assert any((a[c : c + 4] == b[c : c + 4]).sum() >= 3 for c in range(0, neardup.SYMBOLS, neardup.CHUNK))


def test_packing(docs, rows, empty):
    lib = library(BYTES)
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in rows}
    out = packing.packed(docs, BYTES).collect()
    assert sum(r["length"] for r in out) == sum(len(ids[i]) for i, *_ in rows)
    for r in out:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and (r["piece"] == 0 or r["length"] == 1024)
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 1024
    assert packing.packed(empty, BYTES).count() == 0


def test_bin_completion_is_optimal_on_small_cases():
    random.seed(6)

    def fewest(items, room):
        best = [len(items)]

        def put(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[k] <= room:
                    bins[j] += items[k]
                    put(k + 1, bins)
                    bins[j] -= items[k]
            put(k + 1, [*bins, items[k]])

        put(0, [])
        return best[0]

    for _ in range(60):
        items = sorted((random.randint(20, 70) for _ in range(random.randint(4, 10))), reverse=True)
        got = packing.plan(Counter(items), 100)
        assert sum((Counter({x: n * k for x, n in Counter(p).items()}) for p, k in got), Counter()) == Counter(items)
        assert all(sum(p) <= 100 for p, _ in got) and sum(k for _, k in got) == fewest(items, 100)
        complete = packing.plan(Counter(items), 100, None, None, None)
        assert sum(k for _, k in complete) == fewest(items, 100)


def test_rans_files(docs, rows, empty):
    lib = library(BYTES)
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in rows}
    got = rans.round_trip(docs, BYTES).orderBy("start").collect()
    at = 0
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    for r in got:
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    assert rans.round_trip(empty, BYTES).count() == 0


def test_documents_over_block_borders(spark):
    """One document fills more than a block of its file; others lie before and after it."""
    made = [(i, f"number {i}") for i in range(40)] + [(40, " the" * 2_300_000)] + [(i, f"and {i} more") for i in range(41, 80)]
    lib = library(BYTES)
    ids = {i: np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in made if i != 40}
    the = lib.encode(" the", add_special_tokens=False).ids
    ids[40] = np.array(the * 2_300_000 + [2], "<u4")
    got = rans.round_trip(spark.createDataFrame(made, "doc_id long, text string").repartition(3), BYTES).orderBy("start").collect()
    at = 0
    assert [r["doc_id"] for r in got] == list(range(80)) and len(ids[40]) > 2 * rans.BLOCK_IDS
    for r in got:
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_checksums_join():
    rng = np.random.default_rng(3)
    data = rng.bytes(5000)
    for cut in (0, 1, 7, 2500, 4999, 5000):
        assert rans.crc32_joined(zlib.crc32(data[:cut]), zlib.crc32(data[cut:]), 5000 - cut) == zlib.crc32(data)


@pytest.mark.parametrize("n", [1, 2, 4095, 4096, 4097, 3_000_000])
def test_rans_round_trip_and_checksum(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 50_000).astype(np.uint32)
    blob = rans.dump([5, None], np.array([1, n - 1]), ids)
    doc, lengths, back = rans.load(blob)
    assert doc == [5, None] and lengths.tolist() == [1, n - 1] and (back == ids).all()
    broken = bytearray(blob)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        rans.load(bytes(broken))
