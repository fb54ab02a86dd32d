"""Token ids of many texts at once, equal to those of the byte-level BPE tokenizer of the public vocabulary.

Such a tokenizer first parts a text into pretokens and then merges bytes inside each. Here the text is parted only where every
reading of the pretoken pattern has a border, all in vector operations over the bytes; the ids of each chunk come from a
direct-mapped cache of fixed size, and chunks that are not in it are encoded together in one call. Strings of added tokens, such as
the end of a text, part a text before that, and each is one id, as the vocabulary file says.
"""

from __future__ import annotations

import json
import re

import numpy as np

from veilspark.llm.common import flat, prefix_sums, slices, span_hashes

_BYTE = np.arange(256)
SPACE = np.isin(_BYTE, [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)])
LETTER = ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
#: ASCII signs that never belong to a contraction.
SIGN = (_BYTE > 0x20) & (_BYTE < 0x7F) & ~LETTER & ~DIGIT & (_BYTE != 0x27)
PLAIN = (_BYTE < 128) & ~SPACE
NEWLINE = 10
#: Chunks that keep to themselves between line ends: one space at most, then no white space, and a plain or C3 letter at both ends.
SIMPLE = re.compile(rb" ?(?:[!-~]|\xc3[\x80-\xbf])(?:[!-\xff]*(?:[!-~]|\xc3[\x80-\xbf]))?").fullmatch


def borders(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a pretoken surely starts, the starts of texts included."""
    n = len(b)
    at = np.zeros(n, bool)
    if n > 2:
        before, before2 = np.empty(n, np.uint8), np.empty(n, np.uint8)
        before[0], before[1:] = 0x20, b[:-1]
        before2[:2], before2[2:] = 0x20, b[:-2]
        # A letter of two bytes under C3; the signs x97 and xB7 there are no letters, but no white space either.
        two = (before2 == 0xC3) & (before >= 0x80)
        solid = PLAIN[before] | two
        at = SPACE[b] & solid
        at |= SIGN[b] & (LETTER[before] | (two & (before != 0x97) & (before != 0xB7)))
        after = (PLAIN[b] | (b == 0xC3)) & (before == NEWLINE)
        at[1:] |= after[1:] & at[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    at[starts] = True
    # The byte before a text belongs to another one: what was said of the second byte may rest on it.
    second = starts[starts + 1 < n] + 1
    at[second] = (SIGN[b[second]] & LETTER[b[second - 1]]) | (SPACE[b[second]] & PLAIN[b[second - 1]])
    at[starts] = True
    return at


class Encoder:
    """Ids for slices of texts. bits: log2 of the cache's places."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str, bits: int = 19) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        # The file shows a printable byte as itself, and the others as the characters from U+0100 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(c): c for c in printable} | {chr(0x100 + k): c for k, c in enumerate(sorted(set(range(256)) - set(printable)))}
        self.added = {t["content"].encode(): t["id"] for t in model["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t.encode() not in self.added}
        self.part = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.encoding = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.newline = self.encoding.encode_ordinary("\n")[0]
        self.bits, self.most = bits, 8 << bits
        self.clear()

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int32)
        self.pool, self.used = np.zeros(1 << self.bits, np.uint32), 0

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after another, and how many each has."""
        simple = [SIMPLE(c) is not None for c in chunks]
        joined = "\n".join(c.decode("utf-8", "replace") for c, s in zip(chunks, simple, strict=True) if s)
        ids = np.array(self.encoding.encode_ordinary(joined), np.uint32)
        ends = np.append(np.flatnonzero(ids == self.newline), len(ids))
        sizes = np.zeros(len(chunks), np.int64)
        if any(simple):
            sizes[np.array(simple)] = np.diff(ends, prepend=-1) - 1
        if all(simple):
            return ids[ids != self.newline], sizes
        ids, out, k = ids[ids != self.newline], [], 0
        for i, (c, s) in enumerate(zip(chunks, simple, strict=True)):
            if s:
                out.append(ids[k : k + sizes[i]])
                k += sizes[i]
            else:
                out.append(np.array(self.encoding.encode_ordinary(c.decode("utf-8", "replace")), np.uint32))
                sizes[i] = len(out[-1])
        return np.concatenate(out), sizes

    def encode(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts b[offsets[i]:offsets[i + 1]], and where each text's ids start (one more than texts)."""
        start = np.flatnonzero(borders(b, offsets))
        end = np.append(start[1:], len(b))
        h = span_hashes(prefix_sums(b), start, end) | np.uint64(1)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        hit = self.keys[slot] == h
        size = np.where(hit, self.size[slot], 0).astype(np.int64)
        at = self.at[slot]
        if not hit.all():
            lost = np.flatnonzero(~hit)
            fresh, first, back = np.unique(h[lost], return_index=True, return_inverse=True)
            raw = b.tobytes()
            where = lost[first]
            ids, sizes = self.encode_chunks([raw[i:j] for i, j in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            if self.used + len(ids) > self.most:
                # Ids that this slice has found stay readable: they are copied to the head of the new pool.
                old, own = self.pool, np.flatnonzero(hit)
                self.clear()
                keep = _expand(at[own], size[own])
                self.pool, self.used = np.concatenate([old[keep], np.zeros(1 << self.bits, np.uint32)]), len(keep)
                at[own] = np.cumsum(size[own]) - size[own]
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            begin = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
            place = (fresh >> np.uint64(64 - self.bits)).astype(np.int64)
            self.keys[place], self.at[place], self.size[place] = fresh, begin, sizes
            at[lost], size[lost] = begin[back], sizes[back]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.pool[_expand(at, size)], total[np.searchsorted(start, offsets)]


def _expand(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... size[0] of them, then those of at[1] and so on."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return np.arange(total) + np.repeat(at - (ends - size), size)


def encoded(column, encoder: Encoder):
    """(row, ids) of each text of an Arrow column, in order."""
    data, offsets = flat(column)
    for i, j in slices(offsets):
        b, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        # Added tokens never cross texts: a match counts if it ends in the text where it starts.
        found = [(*m.span(), encoder.added[m[0]]) for m in encoder.part.finditer(b.tobytes())] if encoder.part else []
        found = [x for x in found if np.searchsorted(own, x[0], side="right") == np.searchsorted(own, x[1], side="left")]
        if not found:
            ids, at = encoder.encode(b, own)
        else:
            cuts = np.unique(np.concatenate([own, [x for a, e, _ in found for x in (a, e)]]))
            ids, at = encoder.encode(b, cuts)
            # The ids of an added token's own stretch give way to its id.
            whole = np.ones(len(ids), bool)
            for a, _, token in found:
                k = int(np.searchsorted(cuts, a))
                ids[at[k]] = token
                whole[at[k] + 1 : at[k + 1]] = False
            at = np.concatenate([[0], np.cumsum(whole)])[at][np.searchsorted(cuts, own)]
            ids = ids[whole]
        for row in range(i, j):
            yield row, ids[at[row - i] : at[row - i + 1]]
