"""Token ids of whole batches from a byte-level vocabulary file of the tokenizers library.

The library encodes each distinct pre-split piece once; texts are put together from those ids. Texts outside the
vectorised pre-splitting go through the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import presplit
from .bpe import byte_alphabet

#: Distinct pieces that a worker keeps; beyond it the store starts anew.
MAX_PIECES = 400_000


class GptIds:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.model, self.alphabet = self.library.model, {i: ord(c) for i, c in enumerate(byte_alphabet())}
        self.pieces: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, end_id after each text (no nulls), and the n + 1 offsets of the texts in them."""
        rare = presplit.odd(texts, self.specials)
        pieces, at = presplit.gpt_pieces(texts.filter(pa.array(~rare)))
        coded = pieces.dictionary_encode()
        index, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        if len(self.pieces) > MAX_PIECES:
            self.pieces.clear()
        new = [w for w in distinct if w not in self.pieces]
        for w in new:  # a piece needs no further splitting, so the library's model takes it as it is
            self.pieces[w] = np.array([t.id for t in self.model.tokenize(w.decode("latin-1").translate(self.alphabet))], np.uint32).tobytes()
        known = [self.pieces[w] for w in distinct]
        store = np.frombuffer(b"".join(known), np.uint32)
        size = np.array([len(b) for b in known], np.int64) // 4
        first = np.cumsum(size) - size
        count = size[index]
        ends = np.cumsum(count)
        ids = store[np.repeat(first[index] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate(([0], ends))[at]
        if not rare.any():
            out = np.insert(ids, cut[1:], np.uint32(end_id))
            return out, cut + np.arange(len(cut))
        whole = iter(self._encode(texts.filter(pa.array(rare)).to_pylist()))
        parts, k, stop = [], 0, np.array([end_id], np.uint32)
        for is_rare in rare:
            if is_rare:
                parts += [next(whole), stop]
            else:
                parts += [ids[cut[k] : cut[k + 1]], stop]
                k += 1
        lengths = [len(parts[i]) + 1 for i in range(0, len(parts), 2)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(lengths)))


_LOADED: dict[str, GptIds] = {}


def loaded(path: str) -> GptIds:
    """One per worker process."""
    if path not in _LOADED:
        _LOADED[path] = GptIds(path)
    return _LOADED[path]
