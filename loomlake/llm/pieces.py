"""Encoding texts with byte-level tokenizers, with the ids of words met before."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Remembered:
    """Encodes texts with a tokenizer whose matches never run over a single inner space.

    Such a space, between two characters that are no white space, starts a new match, so a
    text falls into words there, each remembered with the space before it. New words are
    encoded together, as one text, and cut apart by the bytes that each id stands for. A
    text in which a space touches other white space is encoded as a whole. The memory has
    two generations: words of the older one that come up again move to the newer, the others
    go when the newer is full.
    """

    def __init__(self, encode: Callable[[str], np.ndarray], bytes_of_id: np.ndarray, words: int = 120_000):
        self.encode_text = encode
        self.bytes_of_id = bytes_of_id
        self.limit = words
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def _learn(self, plain: list[str]) -> None:
        ids = self.encode_text(" " + " ".join(plain))
        ends = np.cumsum([len(w.encode()) + 1 for w in plain])
        cuts = (ids.itemsize * (np.searchsorted(np.cumsum(self.bytes_of_id[ids]), ends) + 1)).tolist()
        raw = ids.tobytes()
        self.words.update(zip(plain, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, in the byte form of what the tokenizer returns."""
        if len(self.words) > self.limit:
            self.words, self.older = {}, self.words
        if len(self.heads) > self.limit // 4:
            self.heads = {}
        parts = [t.split(" ") for t in texts]
        first = [p.pop(0) for p in parts]
        words, older, heads = self.words, self.older, self.heads
        plain, odd = [], set()
        for w in set().union(*parts) - words.keys():
            if w in older:
                words[w] = older[w]
            elif not w or w[0].isspace() or w[-1].isspace():
                odd.add(w)
            else:
                plain.append(w)
        for at in range(0, len(plain), 5_000):
            self._learn(plain[at : at + 5_000])
        out, get = [], words.__getitem__
        for text, head, rest in zip(texts, first, parts):
            if head[-1:].isspace() or (odd and not odd.isdisjoint(rest)):
                out.append(self.encode_text(text).tobytes())
                continue
            if head not in heads:
                heads[head] = self.encode_text(head).tobytes()
            out.append(heads[head] + b"".join(map(get, rest)))
        return out
