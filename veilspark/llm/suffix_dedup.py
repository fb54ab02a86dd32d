"""Removal of byte strings of a given length that occur more than once in a corpus, by a distributed suffix merge sort.

Sorting every suffix of a large corpus is out of reach, and suffixes that cannot match need no sorting. So:

1. Winnowing marks anchors: of the k-byte grams in each window of `size` bytes the one with the least hash. Equal windows mark the
   same place, so a window can only repeat if its anchor's gram does. Each anchor stands for a run of consecutive windows; the bytes
   that they cover are its context. Anchors whose gram occurs once are dropped by a pre-aggregated count.
2. A context that occurs again as a whole is one suffix to sort. Of one that does not, though its gram occurs in other contexts, the
   windows are told apart by their distance from the gram, first in stretches of SPAN: all windows of a stretch share a core of bytes
   around the gram, and those whose core occurs once are dropped. A stretch that occurs again as a whole is a suffix, and of the
   rest the single windows whose fingerprint occurs again, joined where neighbours occur again together. Every step is a pre-aggregated count, so however many contexts a gram
   has, none of them meet in a task.
3. The suffixes are sorted in each task into runs, in which equal ones collapse, written front-coded (the length of the prefix
   shared with the one before, and the rest), and dealt to buckets by their fingerprint.
4. In a bucket a loser tree merges the runs. Every head knows its common prefix with the suffix last put out, so that of two heads
   the one with the longer such prefix is smaller without a look at a byte, and equal prefixes are never compared again. Equal
   suffixes are repeats: fingerprints only propose, bytes decide.

Texts are UTF-8 bytes; matches never cross texts. Defined results: null text counts as empty, texts shorter than `size` keep
everything, repeated rows are copies of each other, no rows give no rows, a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm.common import dropped, durable, flat, mapped, mix, prefix_sums, slices, span_hashes

#: Windows in a stretch.
SPAN = 16
RUN_BYTES = 20 << 20
BUCKET_BYTES = 4 << 20
MORE = np.uint64(0xFFFFFFFFFFFFFFFF)


def anchors(b: np.ndarray, offsets: np.ndarray, size: int, k: int) -> tuple[np.ndarray, ...]:
    """Of each anchor in the texts: text, gram hash, context hash, first window (from the text's start), number of windows, place in the context."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    n, w = len(b), size - k + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if n < size:
        return none
    s = np.arange(n - size + 1)
    s = s[s + size <= offsets[1:][row[: n - size + 1]]]
    if not len(s):
        return none
    sums = prefix_sums(b)
    at = np.arange(n - k + 1)
    gram = span_hashes(sums, at, at + k)
    # The least hash by its upper half; the lower half holds the place, so the leftmost wins a tie in every copy alike.
    order = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    blocks = -(-len(order) // w) + 1
    padded = np.full(blocks * w, MORE)
    padded[: len(order)] = order
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.ascontiguousarray(np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    x = (np.minimum(behind[s], ahead[s + w - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (x[1:] != x[:-1]) | (s[1:] != s[:-1] + 1)
    head = np.flatnonzero(new)
    lo, many, x = s[head], np.diff(np.append(head, len(s))), x[head]
    context = mix(span_hashes(sums, lo, lo + many - 1 + size) + (x - lo).astype(np.uint64))
    own = row[lo]
    return own, gram[x], context, lo - offsets[own], many, x - lo


def packed(lo: np.ndarray, many: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Windows as one number each: the first one, how many less one, and the distance from the first to the anchor's gram."""
    return (lo << 16) | ((many - 1) << 8) | place


def unpacked(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return p >> 16, ((p >> 8) & 255) + 1, p & 255


def _anchored(keyed: DataFrame, size: int, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(3))
            for i, j in slices(offsets):
                own = offsets[i : j + 1] - offsets[i]
                b = data[offsets[i] : offsets[j]]
                row, gram, context, lo, many, place = anchors(b, own, size, k)
                cut = pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(c)) for c in (gram.view(np.int64), context.view(np.int64), packed(lo, many, place))]
                raw = b.tobytes()
                sha = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(own.tolist(), own[1:].tolist(), strict=False)]
                head = [batch.column(c).slice(i, j - i) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(np.diff(own)), pa.array(sha, pa.string()), *lists], names=["doc_id", "_a", "_b", "_bytes", "_sha", "g", "c", "p"])

    return mapped(keyed.select("doc_id", "_a", "_b", "_text"), run, "doc_id long, _a long, _b long, _bytes long, _sha string, g array<long>, c array<long>, p array<long>")


def _squeezed(keyed: DataFrame) -> DataFrame:
    """_a, _b and the text compressed: what is shuffled."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            out = [squeeze(t.encode()) if t else b"" for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["_za", "_zb", "_z"])

    return mapped(keyed.select("_a", "_b", "_text"), run, "_za long, _zb long, _z binary")


def _opened(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix of a and b, which is known to be h at least."""
    most, step = min(len(a), len(b)), 32
    while h < most and a[h : h + step] == b[h : h + step]:
        h += step
    h = min(h, most)
    while h < most and step > 1:
        step //= 2
        if a[h : h + step] == b[h : h + step]:
            h += step
    return min(h + (h < most and a[h] == b[h]), most)


class LoserTree:
    """Merges sorted runs of (key, common prefix with the key before). Heads are compared from where their prefixes end."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]) -> None:
        self.runs = [r for r in runs]
        self.k = max(1, len(runs))
        self.at = [0] * self.k
        self.key: list[bytes | None] = [keys[0] if keys else None for keys, _ in runs] or [None]
        self.lcp = [0] * self.k
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _play(self, i: int) -> None:
        """Stream i moves up from its leaf; an empty node keeps it until its rival comes."""
        node = (i + self.k) // 2
        while node:
            j = self.tree[node]
            if j < 0:
                self.tree[node] = i
                return
            if self._beats(j, i):
                self.tree[node], i = i, j
            node //= 2
        self.tree[0] = i

    def _beats(self, j: int, i: int) -> bool:
        """Whether the head of j goes before that of i; the loser's prefix is then the one it shares with the winner."""
        a, b = self.key[j], self.key[i]
        if b is None or a is None:
            return b is None
        p, q = self.lcp[j], self.lcp[i]
        if p != q:
            return p > q
        h = common(a, b, p)
        first = h == len(a) or (h < len(b) and a[h] < b[h])
        self.lcp[i if first else j] = h
        return first

    def __iter__(self) -> Iterator[tuple[bytes, int, int, int]]:
        """(key, common prefix with the key before, run, place in the run)"""
        while (key := self.key[i := self.tree[0]]) is not None:
            yield key, self.lcp[i], i, self.at[i]
            keys, lcps = self.runs[i]
            self.at[i] += 1
            if self.at[i] < len(keys):
                self.key[i], self.lcp[i] = keys[self.at[i]], lcps[self.at[i]]
            else:
                self.key[i] = None
            self._play(i)


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared prefix lengths, lengths, and the rest of each key, of sorted keys."""
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    shared = np.zeros(len(keys), np.int64)
    for i in range(1, len(keys), 8192):
        own = keys[i - 1 : i + 8192]
        width = max(map(len, own))
        grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in own), np.uint8).reshape(len(own), width)
        differ = grid[1:] != grid[:-1]
        shared[i : i + len(own) - 1] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared = np.minimum(shared, np.minimum(size, np.concatenate([[0], size[:-1]])))
    return shared.astype(np.uint16 if shared.max(initial=0) < 65536 else np.uint32), size.astype(np.uint32), b"".join(x[h:] for x, h in zip(keys, shared.tolist(), strict=True))


def decoded(shared: np.ndarray, size: np.ndarray, rest: bytes) -> tuple[list[bytes], list[int]]:
    keys, lcps, last, at = [], shared.tolist(), b"", 0
    for h, n in zip(lcps, size.tolist(), strict=True):
        last = last[:h] + rest[at : at + n - h]
        at += n - h
        keys.append(last)
    return keys, lcps


def stretches(b: np.ndarray, lo: np.ndarray, many: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Core hash, hash, first window and number of windows of each stretch of the anchors' windows, cut at multiples of SPAN from the gram."""
    sums = prefix_sums(b)
    first, last = (place - many + 1) // SPAN, place // SPAN
    count = last - first + 1
    of = np.repeat(np.arange(len(lo)), count)
    j = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    # Any window of the stretch holds the whole core, so the core lies in the text even if other windows of the stretch do not.
    last_start = (lo + place)[of] - SPAN * j
    start, end = np.maximum(last_start - SPAN + 1, lo[of]), np.minimum(last_start, (lo + many - 1)[of])
    core = mix(span_hashes(sums, last_start, last_start - SPAN + 1 + size) + j.astype(np.uint64))
    whole = mix(span_hashes(sums, start, end + size) + (last_start - start).astype(np.uint64))
    return core, whole, start, end - start + 1


def windows(b: np.ndarray, lo: np.ndarray, many: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Hash (twice), first window and number (1) of each window of the stretches."""
    sums = prefix_sums(b)
    start = np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    h = span_hashes(sums, start, start + size)
    return h, h, start, np.ones(len(start), np.int64)


def _parts(opened: DataFrame, cut, size: int) -> DataFrame:
    """cut (stretches or windows) of the windows in `_own` of each text: _a, _b, g, c, p."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for a, b, z, own in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                lo, many, place = unpacked(np.array(own, np.int64))
                core, whole, start, n = cut(np.frombuffer(_opened(z), np.uint8), lo, many, place, size)
                out.append((np.full(len(core), a), np.full(len(core), b), core.view(np.int64), whole.view(np.int64), packed(start, n, np.zeros(len(n), np.int64))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["_a", "_b", "g", "c", "p"])

    return mapped(opened.select("_a", "_b", "_z", "_own"), run, "_a long, _b long, g long, c long, p long")


def _again(parts: DataFrame) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """Of parts (_a, _b, g, c, p) those whose c occurs again, and the others whose g does, with one of each such c beside them; and
    the tables that both are read from.

    Both tables of keys are written before they are joined: a join of two plain shuffles is one that Spark splits where a key is hot.
    """
    grams = durable(parts.groupBy("g").agg(F.count("*").alias("_times"), (F.min("c") != F.max("c")).alias("_varied")).where("_times > 1").select(F.col("g").alias("_g"), "_varied"), "keys")
    live = durable(parts.join(grams, F.col("g") == F.col("_g")).select("_a", "_b", "c", "p", "_varied"), "live")
    dropped(grams)
    same = durable(live.where("_varied").groupBy("c").agg(F.count("*").alias("_times")).where("_times > 1").select(F.col("c").alias("_c")), "keys")
    varied = durable(live.where("_varied").join(same, F.col("c") == F.col("_c"), "left").select("_a", "_b", "c", "p", F.col("_c").isNotNull().alias("_same")), "varied")
    dropped(same)
    # One of each c that occurs again speaks for it among those that do not.
    one = varied.where("_same").groupBy("c").agg(F.min(F.struct("_a", "_b", "p")).alias("_one")).select("_one.*")
    return live.where("NOT _varied").select("_a", "_b", "c", "p").union(varied.where("_same").select("_a", "_b", "c", "p")), varied.where("NOT _same").select("_a", "_b", "p").union(one), (live, varied)


def _neighbours(found: DataFrame) -> DataFrame:
    """Single windows that occur again, as longer suffixes: _a, _b, c, p.

    Every window is held against a witness, the least of its fingerprint; neighbours whose witnesses are neighbours, too, are one
    suffix there and here, so that their bytes are sent once and not once for each window.
    """
    at = found.select("_a", "_b", "c", F.shiftright("p", 16).alias("s")).distinct()
    least = durable(at.groupBy("c").agg(F.min(F.struct("_a", "_b", "s")).alias("_w")).select(F.col("c").alias("_c"), F.col("_w._a").alias("_wa"), F.col("_w._b").alias("_wb"), F.col("_w.s").alias("_ws")), "witnesses")
    pairs = at.join(least, F.col("c") == F.col("_c")).where("NOT (_a = _wa AND _b = _wb AND s = _ws)").withColumn("_off", F.expr("s - _ws"))
    ends = ["_a", "_b", "_wa", "_wb", "_off"]
    islands = pairs.withColumn("_island", F.col("s") - F.row_number().over(Window.partitionBy(*ends).orderBy("s")))
    # A number of windows is packed into eight bits.
    runs = islands.groupBy(*ends, "_island", F.expr("s div 128").alias("_part")).agg(F.min("s").alias("s"), F.count("*").alias("n"))
    runs = runs.withColumn("c", F.xxhash64("_wa", "_wb", F.expr("s - _off"), "n"))
    packed_at = lambda first: F.expr(f"shiftleft({first}, 16) + shiftleft(n - 1, 8)").alias("p")
    here, there = runs.select("_a", "_b", "c", packed_at("s")), runs.select(F.col("_wa").alias("_a"), F.col("_wb").alias("_b"), "c", packed_at("(s - _off)"))
    return here.union(there.distinct())


def _of_text(parts: DataFrame, what, name: str) -> DataFrame:
    return parts.groupBy(F.col("_a").alias("_pa"), F.col("_b").alias("_pb")).agg(F.collect_set(what).alias(name))


def _runs(chosen: DataFrame, size: int, buckets: int) -> DataFrame:
    """Sorted, front-coded runs: one row per task's run and bucket."""

    def flush(items: list[tuple]):
        # An item: bucket, key (the bytes), _a, _b, first window, windows. Equal keys collapse; one of them is sent, with its count up to 2.
        items.sort(key=lambda x: x[:2])
        known, i = [], 0
        while i < len(items):
            bucket, keys, ids, times = items[i][0], [], [], []
            while i < len(items) and items[i][0] == bucket:
                if keys and keys[-1] == items[i][1]:
                    times[-1] = 2
                    known.append(items[i][2:])
                else:
                    keys.append(items[i][1])
                    ids.append(items[i][2:])
                    times.append(1)
                i += 1
            # What occurs twice in this run is known to repeat, so its first one is, too; the rest of the world needs one witness.
            blob = pickle.dumps((front_coded(keys), np.array(ids, np.int64), np.array(times, np.uint8)), protocol=5)
            yield bucket, zstandard.ZstdCompressor(level=1).compress(blob), 0, 0, 0, 0
        for a, b, lo, n in known:
            yield -1, b"", a, b, lo, n

    def batch_of(rows):
        columns = list(zip(*rows, strict=True))
        types = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "run", "_a", "_b", "s", "n"])

    def run(batches):
        items, held = [], 0
        for batch in batches:
            for a, b, z, own in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                text = _opened(z)
                for x in own:
                    lo, n = x["p"] >> 16, ((x["p"] >> 8) & 255) + 1
                    part = text[lo : lo + n - 1 + size]
                    items.append((x["c"] % buckets, part, a, b, lo, n))
                    held += len(part) + 200
                if held > RUN_BYTES:
                    yield batch_of(list(flush(items)))
                    items, held = [], 0
        if items:
            yield batch_of(list(flush(items)))

    return mapped(chosen.select("_a", "_b", "_z", "_own"), run, "bucket int, run binary, _a long, _b long, s int, n int")


def _merge(table: pa.Table) -> pa.Table:
    """The runs of a bucket merged: the windows that repeat."""
    parts = [pickle.loads(zstandard.ZstdDecompressor().decompress(x)) for x in table.column("run").to_pylist()]
    out: list[list[int]] = []
    key_before, first, told = None, None, False
    for key, lcp, r, i in LoserTree([decoded(*p[0]) for p in parts]):
        member, times = parts[r][1][i].tolist(), int(parts[r][2][i])
        if key_before is not None and lcp == len(key) == len(key_before):
            if not told:
                out.append(first)
                told = True
            out.append(member)
        else:
            first, told = member, times > 1
            if told:
                out.append(member)
        key_before = key
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([],) * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["_a", "_b", "s", "n"])


def repeats(docs: DataFrame, size: int = 200, k: int = 32, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all texts with their length and hash, the texts that may hold repeats, the repeated windows of each as _spans of s, n)."""
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_a"), F.xxhash64("_text").alias("_b"), "_text")
    anchored = durable(_anchored(keyed, size, k), "anchors")
    heads = durable(anchored.select("doc_id", "_a", "_b", "_bytes", "_sha"), "heads")
    suffixes, opened, read = _again(anchored.select("_a", "_b", F.inline(F.arrays_zip("g", "c", "p"))))
    item = F.struct("c", "p")
    left = _of_text(suffixes, item, "_own").join(_of_text(opened, F.col("p"), "_open"), ["_pa", "_pb"], "full")
    chosen = durable(_squeezed(keyed).join(left, (F.col("_za") == F.col("_pa")) & (F.col("_zb") == F.col("_pb"))).select(F.col("_za").alias("_a"), F.col("_zb").alias("_b"), "_z", "_own", "_open"), "chosen")
    dropped(anchored, *read)
    cut = durable(_parts(chosen.where("_open IS NOT NULL").select("_a", "_b", "_z", F.col("_open").alias("_own")), stretches, size), "stretches")
    more, opened, read = _again(cut)
    dropped(cut)
    texts = chosen.select("_a", "_b", "_z").join(_of_text(opened, F.col("p"), "_own"), F.expr("_a = _pa AND _b = _pb"))
    cut = durable(_parts(texts, windows, size), "windows")
    last, _, also = _again(cut)
    joined = durable(_neighbours(last), "joined")
    late = durable(_of_text(more.union(joined), item, "_late"), "late")
    dropped(cut, joined, *read, *also)
    none = F.array().cast(chosen.schema["_own"].dataType)
    every = chosen.join(late, F.expr("_a = _pa AND _b = _pb"), "left").withColumn("_own", F.concat(F.coalesce("_own", none), F.coalesce("_late", none))).where("size(_own) > 0")
    total = (chosen.agg(F.sum(F.size("_own"))).first()[0] or 0) + (late.agg(F.sum(F.size("_late"))).first()[0] or 0)
    runs = durable(_runs(every, size, max(16, int(total * (size + 90) / BUCKET_BYTES))), "runs")
    merged = runs.where("bucket >= 0").select("bucket", "run").groupBy("bucket").applyInArrow(_merge, "_a long, _b long, s int, n int")
    dropped(late)
    spans = merged.union(runs.where("bucket < 0").select("_a", "_b", "s", "n")).groupBy(F.col("_a").alias("_sa"), F.col("_b").alias("_sb")).agg(F.collect_set(F.struct("s", "n")).alias("_spans"))
    spans = durable(spans, "spans")
    dropped(runs)
    return heads, chosen.select("_a", "_b", "_z"), spans


def _covered(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal byte runs that the windows cover."""
    out: list[list[int]] = []
    for start, end in sorted((x["s"], x["s"] + x["n"] - 1 + size) for x in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, size: int = 200, text: str = "text", doc_id: str = "doc_id", with_bytes: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte runs removed), and the bytes kept where asked for and some went."""
    every, chosen, spans = repeats(docs, size, text=text, doc_id=doc_id)

    def run(batches):
        for batch in batches:
            rows = []
            for a, b, z, own in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                raw, runs, at, kept = _opened(z), _covered(own, size), 0, []
                for x, y in runs:
                    kept.append(raw[at:x])
                    at = y
                rest = b"".join([*kept, raw[at:]])
                rows.append((a, b, len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), [{"start": x, "end": y} for x, y in runs], rest if with_bytes else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["_ra", "_rb", "_removed", "_runs", "_kept", "_where", "_rest"])

    cut = chosen.join(spans, (F.col("_a") == F.col("_sa")) & (F.col("_b") == F.col("_sb"))).select("_a", "_b", "_z", "_spans")
    cut = mapped(cut, run, "_ra long, _rb long, _removed long, _runs long, _kept string, _where array<struct<start:long,end:long>>, _rest binary").dropDuplicates(["_ra", "_rb"])
    out = every.join(cut, (F.col("_a") == F.col("_ra")) & (F.col("_b") == F.col("_rb")), "left")
    columns = ["doc_id", F.col("_bytes").alias("n_bytes"), F.coalesce("_removed", F.lit(0)).alias("n_removed"), F.coalesce("_runs", F.lit(0)).alias("n_spans"), F.coalesce("_kept", "_sha").alias("kept_sha256"), F.coalesce("_where", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans")]
    return out.select(*columns, *([F.col("_rest").alias("kept_bytes")] if with_bytes else []))
