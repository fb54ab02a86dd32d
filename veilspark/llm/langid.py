"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum, over all its
segmentations into pieces, of the product of the piece probabilities; the forward algorithm computes it. No piece crosses a word,
so a text's probability is the product over its words, whole texts count, and a word is worked out once per task.

The piece probabilities come from expectation maximisation over a bounded sample of labelled documents. Every round is a Spark
job whose result has one row per language and piece, so what reaches the driver is bounded by the vocabulary.

Defined results: a null text, or one without letters, gives lang_pred `und` and score 0; so does everything if no row is labelled.
Rows with a null or repeated doc_id are kept as they come. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import BASE, MASK, bounded_sample, flat, mapped, slices, unclashing



def _class(first: str) -> str:
    """The characters whose Unicode category starts with one of the given letters, as ranges of a pattern's class."""
    own = np.array([unicodedata.category(chr(c))[0] in first for c in range(sys.maxunicode + 1)])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edge[::2], edge[1::2], strict=True))


#: A word: a letter, then letters and the marks that go with them.
LETTERS = re.compile(f"[{_class('L')}][{_class('LM')}]*")
#: Words that one task remembers before it forgets them all; bounds memory only.
REMEMBERED = 150_000
#: Multipliers that place a hash in the two tables of pieces.
PLACES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Pieces:
    """The pieces of a sentencepiece vocabulary that are made of letters, in lower case."""

    _loaded: dict[str, Pieces] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
        kept = sorted({p.lower() for p in pieces if LETTERS.fullmatch(p.removeprefix("▁"))})
        self.ids, self.longest = {p: i for i, p in enumerate(kept)}, max(map(len, kept))
        self.n = len(kept)
        self.bits = 20
        hashes = np.array([self.hash_of(p) for p in kept], np.uint64)
        # Two tables; a piece whose place is taken in the first goes to the second, and the table grows until all have a place.
        while True:
            self.tables = [(np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, self.n + 1, np.int32)) for _ in range(2)]
            lost = 0
            for i, h in enumerate(hashes):
                for t, (keys, ids) in enumerate(self.tables):
                    at = self.place(h, t)
                    if ids[at] == self.n + 1:
                        keys[at], ids[at] = h, i
                        break
                else:
                    lost += 1
            if not lost:
                break
            self.bits += 1

    @staticmethod
    def hash_of(piece: str) -> int:
        h, power = 0, 1
        for c in reversed(piece):
            h, power = (h + (ord(c) + 1) * power) & MASK, power * BASE & MASK
        return h

    def place(self, h, t: int):
        with np.errstate(over="ignore"):
            return ((h * np.uint64(PLACES[t])) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        keys, ids = self.tables[0]
        at = self.place(h, 0)
        out = np.where(keys[at] == h, ids[at], np.int32(self.n + 1))
        rest = np.nonzero((out > self.n) & (ids[at] <= self.n))
        if len(rest[0]):
            keys, ids = self.tables[1]
            at = self.place(h[rest], 1)
            out[rest] = np.where(keys[at] == h[rest], ids[at], self.n + 1)
        return out

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def lattice(self, words: list[str]) -> np.ndarray:
        """For words of one length n (with their start mark): ids[word, end, size - 1], the piece of that size that ends there.

        The id n stands for a character outside the vocabulary, n + 1 for no piece.
        """
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        sizes = min(n, self.longest)
        out = np.full((n + 1, sizes, len(words)), self.n + 1, np.int32)
        h, power = np.zeros((len(words), n), np.uint64), 1
        for size in range(1, sizes + 1):
            h = h[:, (size > 1) :] + codes[:, : n - size + 1] * np.uint64(power)
            power = power * BASE & MASK
            found = self.find(h)
            if size == 1:
                found[found > self.n] = self.n
            out[size:, size - 1] = found.T
        return out


def forward(ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha[end, word, language] times exp(scale[word]) of each end: the marginal of every prefix over all segmentations."""
    n1, sizes, w = ids.shape
    alpha, scale, long = np.zeros((n1, w, p.shape[1])), np.zeros((w, 1)), n1 > 42
    alpha[0] = 1
    for end in range(1, n1):
        for size in range(1, min(end, sizes) + 1):
            alpha[end] += alpha[end - size] * p[ids[end, size - 1]]
        if long and end % 8 == 0:  # else very long words would underflow
            top = np.maximum(alpha[max(0, end - sizes) : end + 1].max(axis=(0, 2)), 1e-300)[:, None]
            alpha[max(0, end - sizes) : end + 1] /= top
            scale += np.log(top)
    return alpha, scale


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Indexes of words of one length, as many at a time as fit a few megabytes."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    i = 0
    while i < len(order):
        j, n = i, len(words[order[i]])
        most = max(1, 80_000 // n)
        while j < len(order) and len(words[order[j]]) == n and j - i < most:
            j += 1
        yield order[i:j]
        i = j


def word_scores(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), p.shape[1]))
    marked = ["▁" + w for w in words]
    for own in by_length(marked):
        alpha, scale = forward(pieces.lattice([marked[i] for i in own]), p)
        out[own] = np.log(np.maximum(alpha[-1], 1e-300)) + scale
    return out


def expected(words: list[str], times: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of words of one language, by forward and backward sums; p: one language.

    The sums of each place are kept as fractions of a power of e of its own, so words of any length stay within double precision.
    """
    out = np.zeros(pieces.n + 2)
    marked = ["▁" + w for w in words]
    for own in by_length(marked):
        ids, count = pieces.lattice([marked[i] for i in own]), times[own]
        n1, sizes, w = ids.shape
        prob = p[ids, 0]
        alpha, beta = np.zeros((n1, w)), np.zeros((n1, w))
        up, down = np.zeros((n1, w)), np.zeros((n1, w))
        alpha[0] = beta[-1] = 1
        for end in range(1, n1):
            up[end] = up[end - 1]
            for size in range(1, min(end, sizes) + 1):
                alpha[end] += alpha[end - size] * np.exp(up[end - size] - up[end]) * prob[end, size - 1]
            top = np.maximum(alpha[end], 1e-300)
            alpha[end] /= top
            up[end] += np.log(top)
        for start in range(n1 - 2, -1, -1):
            down[start] = down[start + 1]
            for size in range(1, min(n1 - 1 - start, sizes) + 1):
                beta[start] += beta[start + size] * np.exp(down[start + size] - down[start]) * prob[start + size, size - 1]
            top = np.maximum(beta[start], 1e-300)
            beta[start] /= top
            down[start] += np.log(top)
        for end in range(1, n1):
            for size in range(1, min(end, sizes) + 1):
                share = alpha[end - size] * prob[end, size - 1] * beta[end] * np.exp(np.minimum(up[end - size] + down[end] - up[-1], 700))
                out += np.bincount(ids[end, size - 1], count * share, len(out))
    return out


def learn(labelled: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_docs: int = 3000, rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """Languages, and probs[piece, language] from about max_docs labelled documents at most (their whole texts)."""
    sample = bounded_sample(labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(doc_id, text, lang), doc_id, max_docs)

    def count(batches):
        for batch in batches:
            by: dict[str, Counter] = {}
            for t, name in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                by.setdefault(name, Counter()).update(LETTERS.findall(t.lower()))
            rows = [(name, w, n) for name, words in by.items() for w, n in words.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["lang", "word", "n"])

    counted = mapped(sample, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    pieces = Pieces.load(vocabulary)
    # At the start a piece is likelier the longer it is, so that the first round already prefers whole morphemes.
    size = np.array([len(x) for x in pieces.ids] + [0, 0], float)
    start = 1e-4 ** (1 / np.maximum(size, 1)) * 1e-3
    start[-2:] = 1e-7, 0
    p = np.repeat(start[:, None], max(1, len(langs)), axis=1)
    sent = labelled.sparkSession.sparkContext.broadcast
    for _ in range(rounds if langs else 0):
        shared = sent(p)

        def step(batches, shared=shared):
            own, sums = Pieces.load(vocabulary), {}
            for batch in batches:
                names = np.array(batch.column(0).to_pylist(), object)
                words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                for name in set(names):
                    at = np.flatnonzero(names == name)
                    k = langs.index(name)
                    sums[k] = sums.get(k, 0) + expected([words[i] for i in at], n[at], own, shared.value[:, k : k + 1])
            for k, x in sums.items():
                at = np.flatnonzero(x > 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(x[at])], names=["k", "piece", "n"])

        uses = mapped(counted, step, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n"))
        q = np.full((pieces.n + 2, len(langs)), 0.02)
        for k, i, n in uses.collect():
            q[i, k] += n
        q[-1] = 0
        q[:-1] /= q[:-1].sum(axis=0)
        q[-2] = 1e-7  # a character outside the vocabulary tells nothing
        p = q
        shared.unpersist()
    counted.unpersist()
    return langs, p


def identify(docs: DataFrame, langs: list[str], p: np.ndarray, vocabulary: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs, lang_pred and score: the language's share of the posterior, the log likelihood tempered by the
    root of the number of words, as words of one text are far from independent."""
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text in keep else [F.col(text).alias("_text")]))
    shared, place = docs.sparkSession.sparkContext.broadcast(p), keep.index(text) if text in keep else len(keep)

    def run(batches):
        pieces, p = Pieces.load(vocabulary), shared.value
        known: dict[str, int] = {}
        table = np.zeros((1024, p.shape[1]))
        for batch in batches:
            names, scores = [], []
            column = batch.column(place)
            _, offsets = flat(column)
            for i, j in slices(offsets):
                texts = [LETTERS.findall(t.lower()) if langs and t is not None else [] for t in column[i:j].to_pylist()]
                fresh = list({w for words in texts for w in words if w not in known})
                if len(known) + len(fresh) > REMEMBERED:
                    known.clear()
                    fresh = list({w for words in texts for w in words})
                if len(known) + len(fresh) > len(table):
                    table = np.concatenate([table[: len(known)], np.zeros((len(known) + len(fresh), p.shape[1]))])
                if fresh:
                    table[len(known) : len(known) + len(fresh)] = word_scores(fresh, pieces, p)
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                for words in texts:
                    if not words:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    ll = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0) / np.sqrt(len(words))
                    share = np.exp(ll - ll.max())
                    names.append(langs[int(np.argmax(share))])
                    scores.append(float(share.max() / share.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in frame.dtypes[: len(keep)])
    return mapped(frame, run, f"{schema}, lang_pred string, score double")


def keep_identified(docs: DataFrame, vocabulary: str, least: float = 0.5, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """docs without those that have no letters or no language of score `least` or more; the labels of docs teach. Columns stay."""
    langs, p = learn(docs, vocabulary, text, lang, doc_id)
    plain, names, restored = unclashing(docs)
    found = identify(plain, langs, p, vocabulary, list(names.values()), names[text])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*restored)

