"""Exact token ids of the public word-level BPE vocabulary, found word by word.

The tokenizer lower-cases, drops white space and encodes every pre-token alone, so ids of a text are the concatenation
of the ids of its pre-tokens. Pre-tokens of a whole chunk are found with numpy on the bytes, hashed, and only those that
the worker has not seen yet are given to the tokenizer library. Texts with characters outside ASCII and the Latin-1 and
Latin Extended-A letters (where lower-casing, composition or character classes need Unicode tables) and texts that
contain the start of a special token are encoded whole by the library; the result is the same either way.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from plumbline.llm.textvec import ragged, range_hashes

#: Seen pre-tokens a worker keeps before it starts anew: bounds memory, changes no result.
CACHE_WORDS = 300_000

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[97:123] = _CLASS[65:91] = _CLASS[128:] = _LETTER
_CLASS[48:58] = _DIGIT


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    _loaded: dict[str, WordBpe] = {}

    @classmethod
    def load(cls, path: str | None = None) -> WordBpe:
        """One instance per worker process and vocabulary file; `path` None: the installed public file."""
        path = path or default_path()
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.ends_word[i] = piece.endswith("</w>")
        self.reset()

    def reset(self) -> None:
        self.seen: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)

    def _append(self, hashes: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
        n, at = len(self.seen), int(self.first[len(self.seen)])
        while len(self.first) < n + len(hashes) + 1:
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while len(self.ids) < at + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[at : at + len(ids)] = ids
        self.first[n + 1 : n + 1 + len(hashes)] = at + np.cumsum(counts)
        self.seen.update(zip(hashes, range(n, n + len(hashes)), strict=True))

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _slots(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cache slot of every pre-token."""
        codes, unique = pd.factorize(range_hashes(low, starts, ends))
        if len(self.seen) + len(unique) > CACHE_WORDS:
            self.reset()
        slots = np.array([self.seen.get(h, -1) for h in unique.tolist()], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            at = np.zeros(len(unique), np.int64)
            at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw = low.tobytes()
            words = [raw[starts[i] : ends[i]] for i in at[new].tolist()]
            ids = self.encode_whole(b" ".join(words).decode())
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) != len(words):  # a pre-token was cut otherwise than here: ask for each alone
                each = [self.encode_whole(w.decode()) for w in words]
                ids = np.concatenate(each)
                stops = np.cumsum([len(x) for x in each])
            n = len(self.seen)
            self._append(unique[new].tolist(), ids, np.diff(stops, prepend=0))
            slots[new] = np.arange(n, n + len(new))
        return slots[codes]

    def pretokens(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-cased bytes, starts, ends, odd): odd marks documents that only the library can encode."""
        n = len(data)
        nxt = np.zeros(n, np.uint8)
        nxt[:-1] = data[1:] if n else 0
        strange = (data >= 0xC6) | (data == 0xC2) | ((data == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7)))
        strange |= ((data == 0xC4) & (nxt == 0xB0)) | ((data == 0x3C) & (nxt == 0x7C))
        odd = np.zeros(len(offs) - 1, bool)
        hits = np.flatnonzero(strange)
        if len(hits):
            odd[np.searchsorted(offs, hits, "right") - 1] = True
        kind = _CLASS[data]
        if odd.any():
            data = data.copy()
            at = ragged(offs[:-1][odd], np.diff(offs)[odd])
            data[at], kind[at] = 32, _SPACE
        low = np.frombuffer(data.tobytes().decode().lower().encode(), np.uint8)
        before = np.zeros(n, np.uint8)
        before[1:] = kind[:-1]
        before[offs[offs < n]] = _SPACE
        start = (kind != _SPACE) & ((kind != before) | (kind == _DIGIT))
        # contractions: an apostrophe that begins a pre-token takes s, t, m, d, re, ve or ll with it
        quote = np.flatnonzero(start & (low == 39))
        if len(quote):
            last = offs[np.searchsorted(offs, quote, "right")]
            b1 = np.where(quote + 1 < last, low[np.minimum(quote + 1, n - 1)], 0)
            b2 = np.where(quote + 2 < last, low[np.minimum(quote + 2, n - 1)], 0)
            one = np.isin(b1, [115, 116, 109, 100])
            two = ((b1 == 114) & (b2 == 101)) | ((b1 == 118) & (b2 == 101)) | ((b1 == 108) & (b2 == 108))
            start[quote[one | two] + 1] = False
            cut = quote[one | two] + 1 + np.where(one, 1, 2)[one | two]
            inside = cut < last[one | two]
            cut = cut[inside]
            start[cut] = kind[cut] != _SPACE
        starts = np.flatnonzero(start)
        stop = np.concatenate([starts[1:], [n]])
        space = np.concatenate([np.flatnonzero(kind == _SPACE), [n]])
        ends = np.minimum(stop, space[np.searchsorted(space, starts)])
        if len(starts):
            ends = np.minimum(ends, offs[np.searchsorted(offs, starts, "right")])
        return low, starts, ends, odd

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of all documents of a chunk."""
        low, starts, ends, odd = self.pretokens(data, offs)
        slots = self._slots(low, starts, ends)
        counts = self.first[slots + 1] - self.first[slots]
        word_first = np.searchsorted(starts, offs)
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[ragged(self.first[slots], counts)]
        first = total[word_first]
        if odd.any():
            parts, lengths = [], []
            for i in range(len(odd)):
                part = ids[first[i] : first[i + 1]]
                if odd[i]:
                    part = self.encode_whole(data[offs[i] : offs[i + 1]].tobytes().decode())
                parts.append(part)
                lengths.append(len(part))
            ids = np.concatenate(parts)
            first = np.concatenate([[0], np.cumsum(lengths)])
        return ids, first

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Number of ids of every document of a chunk."""
        low, starts, ends, odd = self.pretokens(data, offs)
        slots = self._slots(low, starts, ends)
        total = np.concatenate([[0], np.cumsum(self.first[slots + 1] - self.first[slots])])
        out = np.diff(total[np.searchsorted(starts, offs)])
        for i in np.flatnonzero(odd):
            out[i] = len(self.encode_whole(data[offs[i] : offs[i + 1]].tobytes().decode()))
        return out
