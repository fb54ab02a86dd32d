"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. In the ideal mix every source that has rows left advances at its weight's share of the
weights of all such sources, so a source's progress by any slot follows in closed form from the weights and the numbers of blocks.
A block is released at the last whole slot at which the ideal mix has not begun it and due at the first by which it is done; earliest
deadline first then fills every slot, and no source is ever a whole block away from its ideal progress. Shares are exact to
double precision; when a source is used up the others go on in their proportions.

Blocks grow with the table, so that there are most_blocks at most: the driver works out their slots in one pass, and the table of
slots that comes to the rows by a broadcast join has that size at most. What reaches the driver is one count per source.

A row's number within its source comes from salted counts and windows over (source, salt), in the order of a hash, so a source
with a third of all rows is spread over many tasks.

Defined results: null is a source of its own; sources without a given weight get the mean of the given ones; weights must be
positive; repeated rows are separate rows; no rows give no rows; all columns are kept but those named as the new ones, which are
replaced; the new ones begin with the given prefix.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm.common import unclashing

#: What a window's ends may be off by in double precision, in slots.
EXACT = 1e-9
NEW = ("block", "slot", "release", "deadline", "position")


def windows(blocks: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Release and deadline of each block of each source.

    By virtual time v a source has done min(w * v, blocks) of its blocks, and the slot is the sum of that over all sources.
    """
    ends = blocks / weights
    order = np.argsort(ends, kind="stable")
    done, rate = np.concatenate([[0.0], np.cumsum(blocks[order])]), weights.sum() - np.concatenate([[0.0], np.cumsum(weights[order])])
    ends = ends[order]

    def slot(v: np.ndarray) -> np.ndarray:
        k = np.searchsorted(ends, v, side="left")
        return done[k] + np.maximum(rate[k], 0.0) * v

    out = []
    for n, w in zip(blocks.tolist(), weights.tolist(), strict=True):
        at = slot(np.arange(int(n) + 1) / w)
        out.append((np.floor(at[:-1] + EXACT).astype(np.int64), np.ceil(at[1:] - EXACT).astype(np.int64)))
    return out


def earliest_deadline_first(spans: list[tuple[np.ndarray, np.ndarray]], names: list[tuple]) -> list[np.ndarray]:
    """The slot of each block: in each slot the released block that is due first, the least name on a tie."""
    rank = {k: i for i, k in enumerate(sorted(range(len(names)), key=names.__getitem__))}
    release, due = [a.tolist() for a, _ in spans], [b.tolist() for _, b in spans]
    slots = [[0] * len(a) for a in release]
    waiting = [(a[0], rank[k], k, 0) for k, a in enumerate(release) if a]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    for t in range(sum(map(len, release))):
        while waiting and waiting[0][0] <= t:
            _, r, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due[k][i], r, k, i))
        last, r, k, i = heapq.heappop(ready)
        if last <= t:
            raise AssertionError("a block missed its deadline")
        slots[k][i] = t
        if i + 1 < len(release[k]):
            heapq.heappush(waiting, (release[k][i + 1], r, k, i + 1))
    return [np.array(s, np.int64) for s in slots]


def schedule(rows: dict[str | None, int], weights: dict[str | None, float], block: int) -> pa.Table:
    """Per block: source number (in the order of rows), block, slot, release, deadline, and the position of its first row."""
    names = list(rows)
    many = np.array([-(-rows[s] // block) for s in names], float)
    spans = windows(many, np.array([weights[s] for s in names], float)) if names else []
    slots = earliest_deadline_first(spans, [(s is not None, s or "") for s in names])
    # The last block of a source may be short; rows behind it move up.
    size = np.full(int(many.sum()), block, np.int64)
    for s, own in zip(names, slots, strict=True):
        size[own[-1]] -= -rows[s] % block
    first = np.cumsum(size) - size
    none = [np.zeros(0, np.int64)]
    joined = lambda parts: np.concatenate([*none, *parts])
    slot = joined(slots)
    return pa.table(
        {
            "_at": joined([np.full(len(s), k) for k, s in enumerate(slots)]),
            "_of": joined([np.arange(len(s)) for s in slots]),
            "_slot": slot,
            "_release": joined([a for a, _ in spans]),
            "_deadline": joined([b for _, b in spans]),
            "_first": first[slot],
        }
    )


def pfair_mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = 32, power: float = 0.7, source: str = "source", doc_id: str = "doc_id", text: str | None = "text", tie: str | None = None, prefix: str = "mix", most_blocks: int = 1 << 20) -> DataFrame:
    """docs with {prefix}_block, {prefix}_slot, {prefix}_release, {prefix}_deadline and {prefix}_position (gapless from 0).

    weights default to each source's rows to the given power, which raises small sources. block is the least number of rows in a
    block. Rows of one source and doc_id are told apart by `text`, or by `tie`, where its xxhash64 is at hand.
    """
    spark = docs.sparkSession
    plain, names, restored = unclashing(docs)
    source, doc_id = names[source], names[doc_id]
    mark = F.col(names[tie]) if tie else F.xxhash64(names[text]) if text and text in names else F.lit(0)
    # Null has a key of its own, so that plain equality joins it, too.
    key = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    keyed = plain.withColumn("_hash", F.xxhash64(F.lit(11), F.col(doc_id), mark)).withColumn("_source", key)
    found = {r[0]: r[1] for r in keyed.groupBy("_source").agg(F.count("*").alias("n")).collect()}
    counts = {(k[1:] if k else None): found[k] for k in sorted(found)}
    known = {s: weights[s] for s in counts if s in weights} if weights else {}
    target = {s: known.get(s, sum(known.values()) / len(known) if known else n**power) for s, n in counts.items()}
    total = sum(counts.values())
    block = max(block, -(-total // max(1, most_blocks - len(counts))))
    # most_blocks rows at most.
    timed = F.broadcast(spark.createDataFrame(schedule(counts, target, block)))
    salts = max(64, total // 20_000)
    keyed = keyed.withColumn("_salt", F.pmod("_hash", F.lit(salts)).cast("int"))
    numbers = spark.createDataFrame([("" if s is None else f"={s}", k) for k, s in enumerate(counts)], "_name string, _index long")
    before = keyed.groupBy("_source", "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.join(numbers, F.col("_source") == F.col("_name")).select(F.col("_source").alias("_s"), F.col("_salt").alias("_t"), "_before", "_index")
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_source", "_salt").orderBy("_hash", doc_id)) - 1)
    placed = ranked.join(before, (F.col("_source") == F.col("_s")) & (F.col("_salt") == F.col("_t"))).withColumn("_row", F.col("_rank") + F.col("_before"))
    placed = placed.withColumn("_block", F.expr(f"_row div {block}")).join(timed, (F.col("_index") == F.col("_at")) & (F.col("_block") == F.col("_of")))
    own = {"block": F.col("_block"), "slot": F.col("_slot"), "release": F.col("_release"), "deadline": F.col("_deadline"), "position": F.col("_first") + F.expr(f"_row % {block}")}
    taken = {f"{prefix}_{c}" for c in NEW}
    kept = [c for c, old in zip(restored, docs.columns, strict=True) if old not in taken]
    return placed.select(*kept, *[own[c].cast("long").alias(f"{prefix}_{c}") for c in NEW])


def mixed_order(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs in the order of the schedule, with their own columns: a range shuffle on the position, so each output file is a stretch of the mix."""
    plain, names, restored = unclashing(docs)
    return pfair_mix(plain, source=names[source], doc_id=names[doc_id], text=names[text], prefix="_mix", **options).orderBy("_mix_position").select(*restored)
