"""BPE encoding and decoding by a tokenization automaton.

``MergeAutomaton`` starts as one state that loops on every base symbol and takes the merges in order of rank. The gadget
of a merge (a, b) acts where a path a b leads from one state to another. It adds an arc labelled ab between them, from
every state that has an arc a, and splits the state after a: all arcs a now lead to a copy that has no arc b. When all
merges are in, exactly one path from the first state spells a given word, and its labels are the word's tokens.

A full table would have 10^9 arcs for 49,000 merges. Two facts make it small. All arcs of one label lead to one state, so
a transition needs the label's ``target`` and whether the state has that arc. And a copy's arcs are those of the state it was split from but for
b, and but for the arcs that later gadgets put together from b. Arcs are numbered so that an arc is followed by those that gadgets
began with it, the latest first; then what a split takes away is one interval of numbers, and a state's row is the union
of the intervals of its splits, kept as sorted bounds. Whether an arc is there is one search in the row.

Encoding goes over a word's symbols and keeps the state that each prefix leads to: every arc that spells what follows a
prefix and that its state has is taken once; as one path alone spells a prefix, no other is needed. Decoding puts out the
labels of the arcs.

The automaton is compiled once, on the driver, and broadcast; its size depends on the vocabulary alone.

Defined cases: null text is empty and has no tokens; special tokens' texts are matched as the library does; repeated rows
are encoded each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import presplit
from .textkit import mapped, text_slices

#: Distinct words that a worker keeps; beyond that they start anew.
MAX_WORDS = 400_000
_NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


class MergeAutomaton:
    """labels: id of every token; merges: pairs in order of rank; suffix: what marks a word's last symbol.

    States are numbered as gadgets make them, from 0 (the first). Labels that no path can have are left out."""

    def __init__(self, labels: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.suffix, self.names = suffix, {i: s for s, i in labels.items()}
        self.states = 1
        #: Label's text to label, for the labels that arcs have; base symbols first.
        self.arcs = {s: i for s, i in labels.items() if len(s.removesuffix(suffix) if suffix else s) == 1}
        self.target = dict.fromkeys(self.arcs.values(), 0)
        self._parts: dict[int, tuple[int, int, int]] = {}  # label: rank, first part, second part
        self._splits: dict[int, dict[int, int]] = {}  # label: arcs that its target lost, with the ranks
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, a, b, labels)
        self._compile()
        self._spelt = None  # made where it is first used

    def _gadget(self, rank: int, a: str, b: str, labels: dict[str, int]) -> None:
        x, y = self.arcs.get(a), self.arcs.get(b)
        if x is None or y is None or a + b not in labels or not self._path(x, y):
            return
        made = self.arcs[a + b] = labels[a + b]
        self._parts[made] = (rank, x, y)
        self.target[made] = self.target[y]  # before the split, which matters where a is b
        self.target[x], self.states = self.states, self.states + 1
        self._splits.setdefault(x, {})[y] = rank

    def _spine(self, label: int, part: int) -> list[tuple[int, int]]:
        """The label, its part on one side, that one's part, ..., each with the rank of the gadget that made the one before."""
        out, until = [], _NEVER
        while True:
            out.append((label, until))
            if label not in self._parts:
                return out
            until, label = self._parts[label][0], self._parts[label][part]

    def _path(self, x: int, y: int) -> bool:
        """Whether the state after x has an arc y now. Its splits are its own, and those before x was made of the label that
        x shares a state with. A split takes y if it took y itself, or a label that y was later put together from."""
        first = self._spine(y, 1)
        for owner, until in self._spine(x, 2):
            lost = self._splits.get(owner)
            if lost and any((r := lost.get(e, _NEVER)) < until and r <= made for e, made in first):
                return False
        return True

    def _compile(self) -> None:
        """Numbers the arcs and writes the rows of the states that arcs lead to."""
        later: dict[int, list[int]] = {}
        for label in self._parts:  # in order of rank
            later.setdefault(self._parts[label][1], []).append(label)
        self.number: dict[int, int] = {}
        end: dict[int, int] = {}
        todo = [(i, False) for i in self.arcs.values() if i not in self._parts]
        while todo:
            label, done = todo.pop()
            if done:
                end[label] = len(self.number)
                continue
            self.number[label] = len(self.number)
            todo.append((label, True))
            todo += [(c, False) for c in later.get(label, ())]  # the latest is popped first

        def interval(label: int, rank: int) -> tuple[int, int]:
            """What a split without the label takes, numbers lo to hi: it, and what later gadgets put together from it."""
            older = next((c for c in reversed(later.get(label, ())) if self._parts[c][0] < rank), None)
            return self.number[label], end[label] if older is None else self.number[older]

        own = {}
        for label, lost in self._splits.items():
            own[label] = (np.array(list(lost.values())), np.array([interval(y, r) for y, r in lost.items()]).reshape(-1, 2))
        rows: dict[int, np.ndarray] = {}
        for label, state in self.target.items():
            if state in rows:
                continue
            taken = [own[o][1][: np.searchsorted(own[o][0], until)] for o, until in self._spine(label, 2) if o in own]
            rows[state] = _union(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
        order = sorted(rows)
        self.row = dict(zip(order, itertools.accumulate((len(rows[q]) for q in order), initial=0), strict=False))
        self.bounds = array("i", np.concatenate([rows[q] for q in order]).astype(np.int32).tobytes()) if order else array("i")
        self.row_end = {q: self.row[q] + len(rows[q]) for q in order}

    def step(self, state: int, label: int) -> int | None:
        """The transition: where the state's arc of this label leads, None if it has none."""
        if state:
            lo = self.row[state]
            if bisect_right(self.bounds, self.number[label], lo, self.row_end[state]) - lo & 1:
                return None
        return self.target[label]

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word in the byte alphabet."""
        if self._spelt is None:
            self._spelt = self._prefixes()
        n, spelt, step = len(word), self._spelt, self.step
        state: list[int | None] = [0] + [None] * n
        came: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        for j in range(n):
            p = state[j]
            if p is None:
                continue
            for i in range(j + 1, n + 1):
                known = spelt.get(word[j:i])
                if known is None:
                    break
                if state[i] is None and (label := known[i == n]) is not None and (q := step(p, label)) is not None:
                    state[i], came[i] = q, (j, label)
        out, i = [], n
        while i:
            if state[i] is None:
                raise ValueError(f"no path spells {word!r}")
            i, label = came[i]
            out.append(label)
        return out[::-1]

    def _prefixes(self) -> dict[str, list[int | None]]:
        """What arcs' labels begin with, and the labels that are it: inside a word and at its end."""
        out: dict[str, list[int | None]] = {}
        for text, label in self.arcs.items():
            ends = bool(self.suffix) and text.endswith(self.suffix)
            plain = text.removesuffix(self.suffix) if ends else text
            for i in range(1, len(plain)):
                out.setdefault(plain[:i], [None, None])
            at = out.setdefault(plain, [None, None])
            if not self.suffix:
                at[:] = label, label
            else:
                at[ends] = label
        return out

    def decode(self, ids: list[int]) -> list[str]:
        return [self.names[i] for i in ids]


def _union(intervals: np.ndarray) -> np.ndarray:
    """Bounds lo, hi, lo, hi, ... of the union of intervals, ascending."""
    if not len(intervals):
        return np.zeros(0, np.int64)
    intervals = intervals[np.argsort(intervals[:, 0], kind="stable")]
    reach = np.maximum.accumulate(intervals[:, 1])
    fresh = np.concatenate(([True], intervals[1:, 0] > reach[:-1]))
    last = np.append(np.flatnonzero(fresh)[1:], len(intervals)) - 1
    return np.stack((intervals[fresh, 0], reach[last]), 1).ravel()


class ByteTables:
    """The automaton's transitions as arrays, for many words of bytes at a time.

    ``after`` leads from what has been spelt of a label, and a byte, to what is spelt then; ``inside`` and ``last`` give the label that is spelt in
    full, within a word and at its end. ``keys`` are the rows of all states, one after another."""

    #: Bytes of the words that go through the arrays; longer ones take ``MergeAutomaton.encode``.
    WIDTH = 32

    def __init__(self, automaton: MergeAutomaton) -> None:
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        spelt = automaton._prefixes()
        inner = {""} | {x[:-1] for x in spelt}
        order = [*sorted(inner, key=len), *(x for x in spelt if x not in inner)]
        at = {x: i for i, x in enumerate(order)}
        self.inner = len(inner)
        self.after = np.full((self.inner, 256), -1, np.int32)
        for x in spelt:
            self.after[at[x[:-1]], byte[x[-1]]] = at[x]
        none = [None, None]
        self.inside, self.last = (np.array([-1 if (v := spelt.get(x, none)[k]) is None else v for x in order], np.int32) for k in (0, 1))
        size = max(automaton.names, default=0) + 1
        rows = {q: i for i, q in enumerate(automaton.row)}
        self.number, self.target = np.zeros(size, np.int64), np.zeros(size, np.int32)
        for label, q in automaton.target.items():
            self.number[label], self.target[label] = automaton.number[label], rows[q]
        self.first_state = rows.get(0, 0)
        self.span = len(automaton.number) + 1
        self.start = np.array(list(automaton.row.values()), np.int64)
        lengths = np.array(list(automaton.row_end.values()), np.int64) - self.start
        self.keys = np.array(automaton.bounds, np.int64) + np.repeat(np.arange(len(lengths)) * self.span, lengths)

    def has_arc(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.keys, state * self.span + self.number[label], "right") - self.start[state]) & 1 == 0

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Labels of words of 1 to WIDTH bytes."""
        n, size = len(words), np.array([len(w) for w in words], np.int64)
        wide = int(size.max(initial=0))
        data = np.frombuffer(b"".join([w.ljust(wide, b"\0") for w in words]), np.uint8).reshape(n, wide)
        state, came, taken = np.full((n, wide + 1), -1, np.int64), np.zeros((n, wide + 1), np.int64), np.zeros((n, wide + 1), np.int64)
        state[:, 0] = self.first_state
        for j in range(wide):
            word = np.flatnonzero((size > j) & (state[:, j] >= 0))
            node, source = np.zeros(len(word), np.int64), state[word, j]
            for i in range(j + 1, wide + 1):
                on = np.flatnonzero((size[word] >= i) & (node < self.inner))
                word, source = word[on], source[on]
                node = self.after[node[on], data[word, i - 1]]
                on = np.flatnonzero(node >= 0)
                if not len(on):
                    break
                word, source, node = word[on], source[on], node[on]
                label = np.where(size[word] == i, self.last[node], self.inside[node])
                spelt = np.flatnonzero((label >= 0) & (state[word, i] < 0))
                spelt = spelt[self.has_arc(source[spelt], label[spelt])]
                to = word[spelt]
                state[to, i], came[to, i], taken[to, i] = self.target[label[spelt]], j, label[spelt]
        every = np.arange(n)
        if (state[every, size] < 0).any():
            raise ValueError("no path spells a word")
        out: list[list[int]] = [[] for _ in words]
        while len(every):
            at = size[every]
            for w, label in zip(every.tolist(), taken[every, at].tolist(), strict=True):
                out[w].append(label)
            size[every] = came[every, at]
            every = every[size[every] > 0]
        return [x[::-1] for x in out]


def compiled(path: str) -> MergeAutomaton:
    """The automaton of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model = told["model"]
    out = MergeAutomaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
    out.names.update({x["id"]: x["content"] for x in told["added_tokens"]})
    return out


class WordBpe:
    """The vocabulary file's pipeline: normalise, split, encode; kept per distinct word."""

    def __init__(self, path: str, automaton: MergeAutomaton) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normaliser, self.splitter, self.automaton = library.normalizer, library.pre_tokenizer, automaton
        self.specials = {x.content: i for i, x in library.get_added_tokens_decoder().items()}
        self.alphabet = {i: ord(c) for i, c in enumerate(byte_alphabet())}
        self.find = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.words: dict[bytes, tuple[int, str, str]] = {}
        self.tables, self.id_text = ByteTables(automaton), {i: str(i) for i in automaton.names}

    def entry(self, ids: list[int]) -> tuple[int, str, str]:
        """Number of ids, their text, and their labels' text."""
        return len(ids), " ".join([self.id_text[i] for i in ids]), " ".join(self.automaton.decode(ids))

    def entries(self, words: list[bytes]) -> list[tuple[int, str, str]]:
        known = self.words
        new = [w for w in words if w not in known]
        if len(known) + len(new) > MAX_WORDS:
            known = self.words = {w: known[w] for w in words if w in known}
        short = [w for w in new if len(w) <= ByteTables.WIDTH]
        for lo in range(0, len(short), 20_000):
            part = short[lo : lo + 20_000]
            known.update(zip(part, map(self.entry, self.tables.encode(part)), strict=True))
        for w in new:
            if len(w) > ByteTables.WIDTH:
                known[w] = self.entry(self.automaton.encode(w.decode("latin-1").translate(self.alphabet)))
        return [known[w] for w in words]

    def odd_text(self, text: str) -> list[int]:
        out: list[int] = []
        for k, piece in enumerate(self.find.split(text) if self.find else [text]):
            if k % 2:
                out.append(self.specials[piece])
            elif piece:
                for word, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(piece) if self.normaliser else piece):
                    out += self.automaton.encode(word)
        return out

    def batch(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """Number of ids, ids as text and decoded text of every text (no nulls)."""
        rare = presplit.odd(texts, list(self.specials)) | presplit.odd(pc.utf8_lower(texts), [])
        pieces, at = presplit.lower_pieces(texts.filter(pa.array(~rare)))
        coded = pieces.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        entries = self.entries(coded.dictionary.to_pylist())
        sizes, ids, labels = np.array([e[0] for e in entries], np.int64), [e[1] for e in entries], [e[2] for e in entries]
        out, k = [], 0
        for i, text_is_odd in enumerate(rare):
            if text_is_odd:
                out.append(self.entry(self.odd_text(texts[i].as_py())))
                continue
            own = index[at[k] : at[k + 1]]
            k += 1
            each = own.tolist()
            out.append((int(sizes[own].sum()), " ".join([ids[x] for x in each]), " ".join([labels[x] for x in each])))
        return out


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str, shared) -> WordBpe:
    """One per worker process; shared: the broadcast automaton."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path, shared.value)
    return _LOADED[path]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of ids and of the decoded text, for every row. path: vocabulary file, on every executor."""
    shared = docs.sparkSession.sparkContext.broadcast(compiled(path))

    def sha(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    def work(batch):
        bpe = loaded(path, shared)
        for part, texts in text_slices(batch):
            got = bpe.batch(texts)
            yield {"doc_id": part.column(0), "n_tokens": [g[0] for g in got], "ids_sha256": [sha(g[1]) for g in got], "decoded_sha256": [sha(g[2]) for g in got]}

    return mapped(docs.select("doc_id", "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
