"""Periodic runs of words: every maximal stretch that repeats itself with a period, and texts with each run cut to one period.

Method (Kolpakov and Kucherov 1999): a suffix automaton gives the LZ factorisation, in which each factor is the longest stretch that has
begun before; Main's algorithm finds, around the start of each factor, the runs that touch it and end in it; what lies wholly inside a
factor has stood before, so its runs are those of the earlier place, moved. All three steps take time linear in the words.

Before that, stretches that cannot belong to a run are left out, which changes no result: in a run of n words and period q, n being at
least `least` and 2 q, the words of every stretch of w = least / 2 words that starts in the first n - q - w + 1 places come again q words
on, and these stretches and their copies cover the run. So a word that no repeated stretch of w words covers parts its text in two, and
each part is looked at for itself, again and again, until nothing changes. This is one sort of 64-bit hashes over a slice of texts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import BASE, SPACES, flat, mapped, mix, prefix_sums, slices, span_hashes, words_of

LEAST = 12
RUN = "struct<start:long,length:long,period:long>"


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, earlier start) of each LZ factor; -1 for a letter that is new. The earlier place may overlap the factor.

    The suffix automaton is kept in flat lists and one table of transitions, so that a long text costs no object per state.
    """
    n, sigma = len(word), max(word, default=0) + 1
    length, link, first, go = [0], [-1], [-1], {}
    out_of: list[list[int]] = [[]]
    last = 0
    for i, c in enumerate(word):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        first.append(i)
        out_of.append([])
        p = last
        while p >= 0 and (q := go.get(p * sigma + c)) is None:
            go[p * sigma + c] = new
            out_of[p].append(c)
            p = link[p]
        if p >= 0:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                first.append(first[q])
                out_of.append(list(out_of[q]))
                for d in out_of[q]:
                    go[twin * sigma + d] = go[q * sigma + d]
                while p >= 0 and go.get(p * sigma + c) == q:
                    go[p * sigma + c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    found, i = [], 0
    while i < n:
        state, j, source = 0, i, -1
        while j < n:
            to = go[state * sigma + word[j]]
            # The stretch word[i:j+1] first ends at first[to]; it has begun before i if that end lies before j.
            if first[to] >= j:
                break
            state, j = to, j + 1
            source = first[to] - (j - i) + 1
        found.append((i, max(j, i + 1), source))
        i = max(j, i + 1)
    return found


def _z(s: list[int]) -> list[int]:
    """How many letters each suffix of s shares with s."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def _touching(word: list[int], before: int, x: int, end: int, least: int, found: dict[tuple[int, int], int]) -> None:
    """Main's step: runs with start <= x that end in (x, end], and those inside [before, x) that end at x.

    [before, x) and [x, end) are neighbouring factors, u and v. Were a run that ends behind x to start q words or more before u, then u
    and the word behind it would have stood before, and u would have been longer; so it starts less than |u| + q before x. With q words
    behind x, q is at most |v|; with q words before x, q is less than |u| + |v|.
    """
    u, v = x - before, end - x
    reach = min(x, 2 * u + v)
    if reach + v < least:
        return
    left, right = word[x - reach : x], word[x:end]
    back = left[::-1]
    hits: list[tuple[int, int, int]] = []
    if v:
        # Periods whose first q words behind x lie in the run.
        fore, aft = _z(right), _z([*back, -1, *right[::-1], *back])
        for q in range(1, v + 1):
            a, b = min(aft[reach + 1 + v - q], reach), fore[q] if q < v else 0
            if a + b >= q and a + q + b >= least:
                hits.append((x - a, x + q + b, q))
    # Periods whose last q words before x lie in the run.
    aft, fore = _z(back), _z([*right, -1, *left, *right])
    for q in range(1, min(reach, u + v) + 1):
        a, b = aft[q] if q < reach else 0, min(fore[v + 1 + reach - q], v)
        if a + b >= q and a + q + b >= least:
            hits.append((x - q - a, x + b, q))
    n = len(word)
    for s, e, q in hits:
        # What goes on beyond the words looked at ends in a later factor, or has ended in an earlier one, and is found there.
        if (s > 0 and word[s - 1] == word[s - 1 + q]) or (e < n and word[e] == word[e - q]):
            continue
        if q < found.get((s, e), q + 1):
            found[s, e] = q


def runs_of(word: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` words and two periods, by start and period."""
    starts: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, int, int]] = []
    before = 0
    for b, c, source in [*factors(word), (len(word), len(word), -1)]:
        found: dict[tuple[int, int], int] = {}
        _touching(word, before, b, c, least, found)
        for (s, e), q in found.items():
            # A run that ends at b and reaches the earlier factor's start has been found there.
            if (s, e, q) not in starts.get(s, ()):
                starts.setdefault(s, []).append((s, e, q))
                out.append((s, e - s, q))
        if source >= 0 and c - b - 2 >= least and starts:
            # Runs strictly inside a factor are those of its earlier place, which may reach into the factor itself.
            move, known = b - source, starts.get
            for s in range(b + 1, c - least):
                for _, e, q in known(s - move, ()):
                    if e + move < c:
                        starts.setdefault(s, []).append((s, e + move, q))
                        out.append((s, e - s + move, q))
        before = b
    return sorted(out, key=lambda r: (r[0], r[2]))


def islands(hashes: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges of words, each of one text, outside of which no run can lie. text: the text of each word, rising."""
    w = least // 2
    n = len(hashes)
    if n < least:
        return []
    part = text.astype(np.int64)
    word = np.arange(n)
    base = np.uint64(BASE)
    while len(word):
        # A stretch starts at each word whose next w - 1 words follow it in the same part.
        whole = np.flatnonzero((part[w - 1 :] == part[: len(part) - w + 1]) & (word[w - 1 :] - word[: len(word) - w + 1] == w - 1)) if len(word) >= w else np.zeros(0, np.int64)
        keys = mix(part[whole].astype(np.uint64) * base + np.uint64(1))
        for k in range(w):
            keys = keys * base + hashes[word[whole + k]]
        keys = mix(keys)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        again = np.zeros(len(ranked), bool)
        again[1:] |= same
        again[:-1] |= same
        cover = np.zeros(len(word) + 1, np.int64)
        hit = whole[order[again]]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + w, -1)
        kept = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        # Words that are no more neighbours part; parts of less than `least` words go.
        fresh = np.ones(len(kept), bool)
        fresh[1:] = (np.diff(word[kept]) != 1) | (np.diff(part[kept]) != 0)
        number = np.cumsum(fresh) - 1
        long = np.bincount(number, minlength=1) >= least if len(kept) else np.zeros(0, bool)
        stay = kept[long[number]] if len(kept) else kept
        if len(stay) == len(word):
            break
        part, word = (number[long[number]] if len(kept) else number), word[stay]
    if not len(word):
        return []
    cut = np.flatnonzero(np.diff(part) != 0) + 1
    firsts, lasts = np.concatenate(([0], cut)), np.concatenate((cut, [len(word)])) - 1
    return list(zip(word[firsts].tolist(), (word[lasts] + 1).tolist(), strict=True))


def _of_slice(raw: np.ndarray, own: np.ndarray, least: int) -> tuple[np.ndarray, list[list[dict]], pa.Array]:
    """Words, runs and collapsed text of each text of a slice; own: offsets relative to raw."""
    start, end, text = words_of(raw, own, SPACES)
    n = np.bincount(text, minlength=len(own) - 1) if len(text) else np.zeros(len(own) - 1, np.int64)
    before = np.concatenate(([0], np.cumsum(n)))
    runs: list[list[dict]] = [[] for _ in range(len(own) - 1)]
    dropped = np.zeros(len(start) + 1, np.int64)
    if len(start) >= least:
        data = raw.tobytes()
        for a, b in islands(span_hashes(prefix_sums(raw), start, end), text, least):
            ids: dict[bytes, int] = {}
            word = [ids.setdefault(data[s:e], len(ids)) for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
            row = int(text[a])
            for s, length, q in runs_of(word, least):
                runs[row].append({"start": a + s - int(before[row]), "length": length, "period": q})
                dropped[a + s + q] += 1
                dropped[a + s + length] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    start, end, text = start[kept], end[kept], text[kept]
    # Each kept word with the space before it, but for the first of a text.
    lead = np.ones(len(start), np.int64)
    if len(start):
        lead[0] = 0
        lead[1:] = text[1:] == text[:-1]
    size = end - start + lead
    places = np.concatenate(([0], np.cumsum(size)))
    source = np.repeat(start - lead - places[:-1], size) + np.arange(places[-1])
    out = raw[np.maximum(source, 0)] if len(raw) else raw
    out[places[:-1][lead == 1]] = 0x20
    per = np.bincount(text, weights=size, minlength=len(own) - 1).astype(np.int64) if len(text) else np.zeros(len(own) - 1, np.int64)
    ends = np.concatenate(([0], np.cumsum(per))).astype(np.int64)
    return n, runs, pa.Array.from_buffers(pa.large_string(), len(own) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(out))]).cast(pa.string())


def find(docs: DataFrame, keep: Sequence[str] = (), *, text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of docs: the columns `keep`, then n_words, runs (by start, then period) and collapsed.

    A run is a stretch of at least max(least, 2 period) words in which words a period apart are equal and that no word beside it extends;
    the period is the smallest. collapsed has the text's words joined by one space, without those that any run contains after its first
    period. Words are parted by the bytes x20 and x09 to x0D, and compared by bytes. A null or empty text has no words and no runs;
    repeated rows give repeated results; other columns are not looked at. Whole texts are worked on: memory grows with the longest one.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    kept = {c: f"_k{i}" for i, c in enumerate(keep)}
    slim = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in kept.items()], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t"))
    fields = {f.name: f for f in slim.schema.fields}
    names = list(kept.values())
    schema = ", ".join([f"`{k}` {fields[k].dataType.simpleString()}" for k in names] + [f"n_words long, runs array<{RUN}>, collapsed string"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("_t"))
            for i, j in slices(offsets):
                n, runs, collapsed = _of_slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], least)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in names], pa.array(n.astype(np.int64)), pa.array(runs, kind), collapsed], names=[*names, "n_words", "runs", "collapsed"])

    return mapped(slim, run, schema).select(*[F.col(k).alias(c) for c, k in kept.items()], "n_words", "runs", "collapsed")
