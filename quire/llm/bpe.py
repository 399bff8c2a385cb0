"""Byte-pair encoding of many texts at once: pre-tokens are found and looked up as arrays, and each distinct one is merged once."""

from __future__ import annotations

import unicodedata
from itertools import batched

import numpy as np

#: Fixed values of the byte-level vocabulary: its one special token and the contractions that are pre-tokens of their own.
MARK, MARK_ID = "<|endoftext|>", 50256
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

OTHER, LETTER, NUMBER, BLANK, UNSEEN = 0, 1, 2, 3, 255
#: Longer pre-tokens are not looked up by hash.
LONG = 64


class Encoder:
    """ids(texts): for each text its ids, by the tokenizers library from the JSON of a byte-level vocabulary.

    The library merges every distinct pre-token once; it would take ten times as long for whole texts. Pre-tokens are known by 64-bit
    hashes. The table of merged ones is dropped when it holds `most` entries."""

    def __init__(self, vocabulary: str, most: int = 300_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(vocabulary)
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # what it gets is one pre-token
        self.most = most
        self.kinds = np.full(0x110000, UNSEEN, np.uint8)
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        """known: sorted hashes; of the k-th, the ids are flat[at[k] : at[k] + size[k]]."""
        self.known = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Add sorted new hashes."""
        flat, size = [], []
        for some in batched(words, 1000):
            for made in self.library.encode_batch_fast(list(some), add_special_tokens=False):
                ids = made.ids
                size.append(len(ids))
                flat += ids
        sizes = np.array(size, np.int64)
        at = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, np.array(flat, "<u4")])
        where = np.searchsorted(self.known, keys)
        self.known, self.at, self.size = (np.insert(old, where, new) for old, new in ((self.known, keys), (self.at, at), (self.size, sizes)))

    def classes(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if (kinds == UNSEEN).any():
            for p in np.unique(points[kinds == UNSEEN]).tolist():
                c = chr(p)
                group = unicodedata.category(c)[0]
                self.kinds[p] = LETTER if group == "L" else NUMBER if group == "N" else BLANK if c.isspace() and not 0x1C <= p <= 0x1F else OTHER
            kinds = self.kinds[points]
        return kinds

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens start, of texts laid end to end; first marks where a text starts."""
        n = len(points)
        kinds = self.classes(points)
        begins = first.copy()
        begins[1:] |= kinds[1:] != kinds[:-1]
        last = np.append(first[1:], True)  # of a text
        blank, space = kinds == BLANK, points == 0x20
        # a blank before a word is alone; as a space it belongs to the word
        before_word = blank[:-1] & ~blank[1:] & ~last[:-1]
        begins[:-1] |= before_word
        begins[1:] &= ~(before_word & space[:-1])
        quotes = np.flatnonzero(points == 0x27)
        quotes = quotes[begins[quotes]]
        for q in quotes.tolist():
            for tail in CONTRACTIONS:
                end = q + 1 + len(tail)
                if end <= n and not last[q:end - 1].any() and all(points[q + 1 + k] == ord(c) for k, c in enumerate(tail)):
                    begins[q + 1] = False
                    if end < n:
                        begins[end] = begins[end] or not first[end]
                    break
        return np.flatnonzero(begins)

    def hashes(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(points)
        base = np.uint64(0x9E3779B97F4A7C15)
        if len(self.powers) <= n:
            self.powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))
            self.inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(pow(int(base), -1, 2**64)))]))
        x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        x *= self.powers[:n]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        h = (sums[end] - sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93) + (end - start).astype(np.uint64)

    def block(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        if not whole:
            return [np.zeros(0, "<u4") for _ in texts]
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        first = np.zeros(len(points), bool)
        first[edges[:-1][edges[:-1] < len(points)]] = True
        start = self.starts(points, first)
        end = np.append(start[1:], len(points))
        key = self.hashes(points, start, end)
        for k in np.flatnonzero(end - start > LONG).tolist():  # a key of its own, not kept
            key[k] = np.uint64(2**64 - 1 - k)
        keys, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.clear()
        found = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), bool)
        inside = found < len(self.known)
        new[inside] = self.known[found[inside]] != keys[inside]
        fresh = where[new]
        self.learn(keys[new], [whole[i:j] for i, j in zip(start[fresh].tolist(), end[fresh].tolist())])
        each = np.searchsorted(self.known, keys)[inverse]
        sizes, at, flat = self.size[each], self.at[each], self.flat
        stop = np.cumsum(sizes)
        ids = flat[np.repeat(at - (stop - sizes), sizes) + np.arange(stop[-1])]
        held = np.searchsorted(self.known, np.uint64(2**64 - 1 - len(points)))  # the keys of long ones hold for this block alone
        self.known, self.at, self.size = self.known[:held], self.at[:held], self.size[:held]
        bounds = np.concatenate([[0], stop])[np.searchsorted(start, edges)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def ids(self, texts: list[str], most: int = 500_000) -> list[np.ndarray]:
        """most: code points that are held as arrays at once, or one text."""
        out: list[np.ndarray] = []
        block: list[str] = []
        held = 0
        for text in texts:
            if MARK in text:
                parts = text.split(MARK)
                out += self.block(block)
                block, held = [], 0
                made = self.block(parts)
                out.append(np.concatenate([x for part in made for x in (part, np.full(1, MARK_ID, "<u4"))][:-1]))
                continue
            if held + len(text) > most and block:
                out += self.block(block)
                block, held = [], 0
            block.append(text)
            held += len(text)
        return out + self.block(block)
