"""Best-fit packing of token pieces into sequences of a fixed length.

The lengths make a histogram with at most `capacity` entries, however large the corpus. On it a configuration linear program (cover
every length's count with as few sequence patterns as possible) is solved by multiplicative weights: a length's price is its share
of a sequence, times a factor that grows while it is covered less than the solution as a whole; a knapsack dynamic program over the
prices finds the next pattern, which is used in a step of bounded width, until every length is covered. Most rounds price the least
covered lengths and a random part of the others, some price all; those give the dual bound. The solution is then rounded: patterns
in the order in which they were found, as often as there are pieces for them. What is left, with the shortest pieces, which the
program is not offered, is packed by best fit on the histogram. If plain best fit over everything needs fewer sequences, as it may
where most lengths occur once or twice, its patterns are taken. Pieces then find their place by rank within their length, all in Spark.

Ranks come from salted counts, so that a length that a third of all pieces share is no single task's work.

Documents with a position are packed in stretches of consecutive positions, each by the same method on its own, so that sequences
follow the order of the documents: stretches come one after another, and within one, earlier pieces of a length go to earlier sequences.

Defined results: a null text counts as empty and is one piece of one token; repeated rows are packed once each; no rows give no
rows. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veilspark.llm.common import durable, mapped
from veilspark.llm.tokens import Encoder, encoded

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CUT = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))


def tokenized(docs: DataFrame, vocabulary: str, capacity: int, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, and _pieces: its ids and a closing 0, cut into pieces of capacity at most, the first one shorter if any is."""
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches):
        encoder = Encoder.load(vocabulary)
        for batch in batches:
            columns, ends = ([], [], [], []), [0]
            for _, own in encoded(batch.column(len(keep)), encoder):
                own = np.append(own, np.uint32(0)).astype("<u4")
                first = len(own) % capacity or capacity
                cuts = [0, *range(first, len(own) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for c, v in zip(columns, (k, a, b - a, zlib.crc32(own[a:b])), strict=True):
                        c.append(v)
                ends.append(len(columns[0]))
            own = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CUT.value_type, strict=True)], fields=list(CUT.value_type))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own)], names=[*keep, "_pieces"])

    head = [f"`{c}` {t}" for c, t in frame.dtypes[: len(keep)]]
    return mapped(frame, run, ", ".join([*head, "_pieces array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"]))


def pieces(docs: DataFrame, vocabulary: str, capacity: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece of each document."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("_t"))
    return tokenized(slim, vocabulary, capacity, "_t", ["doc_id"]).select("doc_id", F.inline("_pieces"))


Pattern = tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Best fit by falling length, on counts: how often each pattern of (length, times) is used."""
    by_room: dict[int, dict[Pattern, int]] = {}
    done: dict[Pattern, int] = {}

    def put(pattern: Pattern, room: int, n: int) -> None:
        at = by_room.setdefault(room, {}) if room else done
        at[pattern] = at.get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                each = capacity // length
                n = max(1, left // each)
                each = min(each, left)
                put(((length, each),), capacity - each * length, n)
                left -= n * each
                continue
            pattern, n = by_room[room].popitem()
            each = min(room // length, left)
            used = min(n, left // each)
            if used < n:
                by_room[room][pattern] = n - used
            if not by_room[room]:
                del by_room[room]
            put((*pattern, (length, each)), room - each * length, used)
            left -= used * each
    for own in by_room.values():
        for pattern, n in own.items():
            done[pattern] = done.get(pattern, 0) + n
    return done


@dataclass
class Solution:
    """patterns and how often each is used; of their pieces those placed by patterns of the linear program; its value and dual bound."""

    patterns: dict[Pattern, int]
    pieces: int = 0
    lp_pieces: int = 0
    lp_value: float = 0.0
    bound: float = 0.0
    rounds: int = field(default=0, compare=False)


def knapsack(lengths: np.ndarray, price: np.ndarray, most: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Times of each length in the pattern of highest price, none above `most`, and that price.

    Dynamic programming over capacities, item by item; an item's times are made of powers of two and a rest.
    """
    best, parts = np.zeros(capacity + 1), []
    for i, (length, value, left) in enumerate(zip(lengths.tolist(), price.tolist(), np.minimum(most, capacity // lengths).tolist(), strict=True)):
        k = 1
        while left:
            k = min(k, left)
            w = k * length
            with_it = best[:-w] + k * value
            parts.append((i, k, w, with_it > best[w:]))
            np.maximum(best[w:], with_it, out=best[w:])
            left -= k
            k *= 2
    times, c = np.zeros(len(lengths), np.int64), capacity
    for i, k, w, taken in reversed(parts):
        if c >= w and taken[c - w]:
            times[i] += k
            c -= w
    return times, float(best[capacity])


def configurations(counts: dict[int, int], capacity: int, width: float, rate: float, priced: int) -> tuple[list[tuple[Pattern, int]], float, float, int]:
    """The covering program over patterns: (pattern, times) in the order found, its value, a lower bound of it, and rounds."""
    lengths = np.array(sorted(counts, reverse=True), np.int64)
    need = np.array([counts[x] for x in lengths.tolist()], np.int64)
    share, covered, draw = lengths / capacity, np.zeros(len(need)), np.random.default_rng(1)
    floor, value, found, rounds = float(share @ need), 0.0, {}, 0
    bound = floor
    while (part := covered / need).min() < 1:
        # Weights of lengths that lag behind grow by rate per whole cover, those of lengths ahead shrink; the more so, the further the
        # program is from its bound.
        over = max(0.0, value / floor - 1)
        price = share * np.exp(np.clip(rate * (1 + 1000 * over) * (value / floor - part), -30, 30))
        every = rounds % 500 == 0
        if every or len(lengths) <= priced:
            own = np.arange(len(lengths))
        else:
            own = np.unique(np.concatenate([np.argpartition(part, 3 * priced // 4)[: 3 * priced // 4], draw.integers(0, len(lengths), priced // 4)]))
        times, top = knapsack(lengths[own], price[own], need[own], capacity)
        if every:
            bound = max(bound, float(price @ need) / top)
        at = np.flatnonzero(times)
        own, times = own[at], times[at]
        step = max(1, int(width * (need[own] // times).min()))
        covered[own] += step * times
        value += step
        rounds += 1
        pattern = tuple(zip(lengths[own].tolist(), times.tolist(), strict=True))
        found[pattern] = found.get(pattern, 0) + step
    return list(found.items()), value, bound, rounds


def solve(counts: dict[int, int], capacity: int, width: float = 0.1, rate: float = 0.02, priced: int = 160, short: int = 32) -> Solution:
    """Patterns that together hold exactly the counts. Pieces of up to 1 / short of the capacity are kept for filling up what is left."""
    if not counts:
        return Solution({})
    offered = {a: n for a, n in counts.items() if a * short > capacity}
    found, value, bound, rounds = configurations(offered, capacity, width, rate, priced) if offered else ([], 0.0, 0.0, 0)
    bound, best = max(bound, sum(a * n for a, n in counts.items()) / capacity), None
    # Rounded twice: with all patterns, what is used up taken out of them, and without those with room to spare, whose pieces best fit
    # may know better places for.
    for least in (0, capacity):
        left, out, placed = dict(counts), {}, 0
        for pattern, x in found:
            while x and pattern and sum(a * n for a, n in pattern) >= least:
                if times := min(x, *(left[a] // n for a, n in pattern)):
                    out[pattern] = out.get(pattern, 0) + times
                    placed += times * sum(n for _, n in pattern)
                    for a, n in pattern:
                        left[a] -= times * n
                    x -= times
                pattern = tuple((a, min(n, left[a])) for a, n in pattern if left[a])
        for pattern, n in best_fit({a: n for a, n in left.items() if n}, capacity).items():
            out[pattern] = out.get(pattern, 0) + n
        if best is None or (sum(out.values()), -placed) < (sum(best[0].values()), -best[1]):
            best = out, placed
    out, placed = best
    plain, pieces = best_fit(counts, capacity), sum(counts.values())
    if sum(plain.values()) < sum(out.values()):
        return Solution(plain, pieces, 0, value, bound, rounds)
    return Solution(out, pieces, placed, value, bound, rounds)


def places(patterns: dict[Pattern, int]) -> list[tuple]:
    """Per length its slots, by rank: (first rank, sequences, first sequence, times in a sequence, offset there)."""
    by: dict[int, list[tuple]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for pattern, n in sorted(patterns.items(), reverse=True):
        offset = 0
        for length, times in pattern:
            by.setdefault(length, []).append((rank.get(length, 0), n, sequence, times, offset))
            rank[length] = rank.get(length, 0) + n * times
            offset += length * times
        sequence += n
    return list(by.items())


SLOTS = T.StructType([T.StructField("_length", T.LongType()), T.StructField("_slots", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("first", "n", "sequence", "times", "offset")])))])


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """cut (as `pieces` gives it, durable) with sequence_id and offset."""
    spark = cut.sparkSession
    # The salt depends on the piece alone; a hot length meets at most its share of one salt in a task.
    salts = max(64, cut.count() // 20_000)
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counted = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(places(solve(histogram, capacity).patterns), SLOTS)
    before = counted.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), "_before")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # At most `capacity` rows: their size does not follow the corpus.
    found = ranked.join(F.broadcast(slots), F.col("length") == F.col("_length")).withColumn("_slot", F.expr("filter(_slots, s -> _rank >= s.first AND _rank < s.first + s.n * s.times)[0]")).withColumn("_at", F.expr("_rank - _slot.first"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("_slot.sequence + _at div _slot.times").alias("sequence_id"), F.expr("_slot.offset + (_at % _slot.times) * length").alias("offset"))


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(durable(pieces(docs, vocabulary, capacity), "pieces"), capacity)


def pack_stretch(cut: pa.Table, capacity: int) -> pa.Table:
    """The pieces of a stretch, which have their position, with sequence_id from 0 and offset."""
    cut = cut.sort_by([("position", "ascending"), ("piece", "ascending")])
    length = cut.column("length").to_numpy()
    by: dict[int, list[int]] = {}
    for i, n in enumerate(length.tolist()):
        by.setdefault(n, []).append(i)
    used = dict.fromkeys(by, 0)
    sequences: list[list[int]] = []
    # The uses of a pattern are spread evenly over the stretch, so that early pieces of a length go to early sequences.
    times = sorted(((j + 0.5) / n, pattern) for pattern, n in solve({n: len(x) for n, x in by.items()}, capacity).patterns.items() for j in range(n))
    for _, pattern in times:
        own = []
        for n, k in pattern:
            own += by[n][used[n] : used[n] + k]
            used[n] += k
        sequences.append(own)
    sequences.sort(key=lambda own: sum(own) / len(own))
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for s, own in enumerate(sequences):
        at = 0
        for i in own:
            sequence[i], offset[i] = s, at
            at += int(length[i])
    return cut.select(["_stretch", "doc_id", "piece", "start", "length", "ids_crc32"]).append_column("_sequence", pa.array(sequence)).append_column("offset", pa.array(offset))


def ordered_packing(docs: DataFrame, vocabulary: str, place, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), capacity: int = 2048, stretch: int = 16384) -> DataFrame:
    """As best_fit_packing, with sequences in the order of the documents' positions; `stretch` documents are packed together.

    place is given the documents with their columns doc_id, `keep` and _tie (a hash of the text) in place of the text, and returns
    them with `position`: texts are tokenized where they are read, and never shuffled.
    """
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), *[F.col(f"`{c}`") for c in keep], F.xxhash64(f"`{text}`").alias("_tie"), F.col(f"`{text}`").alias("_t"))
    cut = place(durable(tokenized(slim, vocabulary, capacity, "_t", ["doc_id", *keep, "_tie"]), "tokenized"))
    cut = cut.select("doc_id", "position", F.inline("_pieces")).withColumn("_stretch", F.expr(f"position div {stretch}"))
    packed = cut.groupBy("_stretch").applyInArrow(lambda own: pack_stretch(own, capacity), f"_stretch long, {PIECES}, _sequence long, offset long")
    packed = durable(packed, "stretches")
    # One row per stretch.
    sizes = sorted((r[0], r[1]) for r in packed.groupBy("_stretch").agg(F.max("_sequence") + 1).collect())
    firsts, first = [], 0
    for k, n in sizes:
        firsts.append((k, first))
        first += n
    before = cut.sparkSession.createDataFrame(firsts, "_k long, _first long")
    return packed.join(F.broadcast(before), F.col("_stretch") == F.col("_k")).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_sequence")).alias("sequence_id"), "offset")
