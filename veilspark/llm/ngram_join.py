"""Similarity self-join of texts on the Jaccard index of their word n-gram sets, by MinHash banding.

Bands and rows are chosen for a target recall at the threshold. Texts with equal n-gram sets are one class from the start. The
classes are shuffled on their band hashes; buckets with the same members as a bucket of an earlier band are dropped, as they hold
no new pair. In each bucket pairs are verified on the full n-gram sets, as products of 0/1 matrices, and a pair counts only in the
first band in which its signatures agree, so each is counted once. What leaves a bucket is a number of links and one edge per class,
never a row per pair. A bucket over `block` members is dealt into blocks, and each pair of blocks is a task of its own: groups in
memory stay bounded, and no pair is lost.

Words are the maximal runs without x20 and x09 to x0D; a text with fewer words than n has one n-gram, all its words; one without
words links with nothing. Defined results: null text counts as empty, a null doc_id stays null, repeated rows are copies of each
other, no rows give no rows; columns beside those named are ignored by the join and kept by `deduplicate`.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import SPACES, components, durable, flat, mapped, mix, prefix_sums, slices, span_hashes, unclashing, words_of

#: Ids up to this many may be broadcast: some 30 MB. More are joined by a shuffle.
BROADCAST_ROWS = 500_000


def banding(threshold: float, recall: float, rows: int = 4) -> int:
    """Bands of `rows` rows that find a pair at the threshold with the given probability."""
    return ceil(np.log(1 - recall) / np.log(1 - threshold**rows))


def ngrams(b: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, and the text of each."""
    start, end, row = words_of(b, offsets, SPACES)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = span_hashes(prefix_sums(b), start, end)
    first = np.searchsorted(row, np.arange(len(offsets)))
    count = np.diff(first)
    gram = h.copy()
    # Where a text has fewer words, the gram stops at its last one.
    at, stop = np.arange(len(h)), first[1:][row]
    for k in range(1, n):
        more = at + k < stop
        gram[more] = mix(gram[more] * np.uint64(0x9E3779B97F4A7C15) + h[at[more] + k] + np.uint64(k))
    keep = (at + n <= stop) | ((count[row] < n) & (at == first[row]))
    gram, row = gram[keep], row[keep]
    order = np.argsort(gram)
    order = order[np.argsort(row[order], kind="stable")]
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    return gram[new], row[new]


def sets_of(column, n: int, bands: int, rows: int, with_sets: bool):
    """(rows, class keys, set sizes, band hashes, sets) of the texts of a column that have words, slice by slice."""
    rng = np.random.default_rng(5)
    flip, times = (rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    data, offsets = flat(column)
    for i, j in slices(offsets):
        gram, row = ngrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
        if not len(gram):
            continue
        head = np.flatnonzero(np.diff(row, prepend=-1))
        own, size = row[head] + i, np.diff(np.append(head, len(row)))
        keys = np.stack([np.add.reduceat(mix(gram ^ np.uint64(c)), head) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)], axis=1)
        signed = np.zeros((len(head), bands), np.uint64)
        for k in range(bands):
            for r in range(rows):
                least = np.minimum.reduceat((gram ^ flip[k * rows + r]) * times[k * rows + r], head)
                signed[:, k] = mix(signed[:, k] * np.uint64(31) + least)
            signed[:, k] = mix(signed[:, k] + np.uint64(k))
        keys = [x.tobytes() for x in keys]
        yield own, keys, size, signed, ([x.tobytes() for x in np.split(gram, head[1:])] if with_sets else None)


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs with _a and _b, which tell rows apart up to exact repetition."""
    return docs.withColumn("_a", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))).withColumn("_b", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _signatures(keyed: DataFrame, text: str, n: int, bands: int, rows: int, with_sets: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for own, keys, size, signed, sets in sets_of(batch.column(2), n, bands, rows, with_sets):
                at = pa.array(own)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary()), pa.array(size.astype(np.int32))]
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * bands), pa.array(signed.reshape(-1).view(np.int64))))
                names = ["_a", "_b", "_k", "_n", "_bands"]
                if with_sets:
                    columns, names = [*columns, pa.array(sets, pa.binary())], [*names, "_set"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(keyed.select("_a", "_b", F.col(text).cast("string").alias("_text")), run, "_a long, _b long, _k binary, _n int, _bands array<long>" + ", _set binary" * with_sets)


def _verify(threshold: float):
    """For one bucket, or one pair of its blocks: per class its links and the least class that it reaches here."""

    def run(table: pa.Table) -> pa.Table:
        keys, sets = table.column("_k").to_pylist(), table.column("_set").to_pylist()
        m, times, block = len(keys), table.column("_times").to_numpy().astype(np.int64), table.column("_block").to_numpy()
        size = table.column("_n").to_numpy().astype(np.int64)
        bands = np.array(table.column("_bands").to_pylist(), np.int64).reshape(m, -1)
        band = table.column("_band")[0].as_py()
        row = np.repeat(np.arange(m), size)
        _, column, seen = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True, return_counts=True)
        number = np.cumsum(seen > 1) - 1
        keep = seen[column] > 1
        row, column = row[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both, width = np.zeros((m, m), np.float32), max(64, (1 << 22) // m)
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            i, j = np.searchsorted(column, [c, c + width])
            one = np.zeros((m, width), np.float32)
            one[row[i:j], column[i:j] - c] = 1
            both += one @ one.T
        near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
        np.fill_diagonal(near, False)
        lo, hi = table.column("_lo")[0].as_py(), table.column("_hi")[0].as_py()
        if lo != hi:  # pairs within a block belong to that block's own task
            near &= block[:, None] != block[None, :]
        links, root = np.zeros(m, np.int64), np.arange(m)
        for p in range(m):
            q = np.flatnonzero(near[p])
            if len(q):
                links[p] = times[q[(bands[q] == bands[p]).argmax(axis=1) == band]].sum()
        order = np.array(sorted(range(m), key=keys.__getitem__))
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        while near.any():
            least = np.minimum(rank[root], np.where(near, rank[root][None, :], m).min(axis=1))
            fresh = order[least]
            if (fresh == root).all():
                break
            root = fresh
        linked = near.any(axis=1)
        return pa.table({"_k": pa.array([keys[p] for p in np.flatnonzero(linked)], pa.binary()), "_links": links[linked], "_root": pa.array([keys[r] for r in root[linked]], pa.binary())})

    return run


def similarity_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, threshold: float = 0.8, recall: float = 0.99999, rows: int = 4, block: int = 512) -> DataFrame:
    """Per row of docs with words: _a, _b (see _keyed), _links (other rows linked directly), _class and _root (class keys)."""
    bands = banding(threshold, recall, rows)
    keyed = _keyed(docs, text, doc_id)
    signed = durable(_signatures(keyed, text, n, bands, rows, False), "signatures")
    classes = signed.groupBy("_k").agg(F.count("*").alias("_times"), F.min(F.struct("_a", "_b")).alias("_one"), F.first("_bands").alias("_bands"))
    dealt = classes.select("_k", F.posexplode("_bands").alias("_band", "_h"))
    bucket = dealt.groupBy("_band", "_h").agg(F.count("*").alias("_size"), F.sum(F.xxhash64("_k").cast("decimal(38,0)")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(3), F.col("_k"))).alias("_y")).where("_size > 1")
    bucket = bucket.groupBy("_size", "_x", "_y").agg(F.min(F.struct("_band", "_h")).alias("_at")).select("_at._band", "_at._h", "_size")
    members = durable(dealt.join(bucket, ["_band", "_h"]), "members")
    wanted = durable(members.select("_k").distinct().join(classes.select("_k", "_times", "_one"), "_k").select("_k", "_times", F.col("_one._a").alias("_wa"), F.col("_one._b").alias("_wb")), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    ids = wanted.select("_wa", "_wb")
    ids = F.broadcast(ids) if few else ids
    sets = _signatures(keyed.join(ids, (F.col("_a") == F.col("_wa")) & (F.col("_b") == F.col("_wb"))), text, n, bands, rows, True)
    sets = sets.select("_k", "_n", "_bands", "_set").dropDuplicates(["_k"]).join(wanted.select("_k", "_times"), "_k")
    placed = members.withColumn("_blocks", F.ceil(F.col("_size") / block).cast("int")).withColumn("_block", F.pmod(F.xxhash64("_k"), F.col("_blocks")).cast("int"))
    placed = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_lo", F.least("_block", "_with")).withColumn("_hi", F.greatest("_block", "_with"))
    placed = placed.select("_k", "_band", "_h", "_block", "_lo", "_hi").join(sets, "_k")
    found = durable(placed.groupBy("_band", "_h", "_lo", "_hi").applyInArrow(_verify(threshold), "_k binary, _links long, _root binary"), "links")
    links = found.groupBy("_k").agg(F.sum("_links").alias("_links"))
    roots = components(found.select(F.col("_k").alias("a"), F.col("_root").alias("b")))
    info = classes.select("_k", "_times").join(links, "_k", "left").join(roots, F.col("_k") == F.col("node"), "left")
    info = info.select(F.col("_k").alias("_class"), (F.coalesce("_links", F.lit(0)) + F.col("_times") - 1).alias("_links"), F.coalesce("root", "_k").alias("_root"))
    # Written, so that this is a join of two plain shuffles, which Spark splits where a class is large; so are the least rows below.
    info = durable(info, "classes")
    return signed.select("_a", "_b", "_k").join(info, F.col("_k") == F.col("_class")).select("_a", "_b", "_links", "_class", "_root")


def linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """Per row of docs: doc_id, n_links, component_id (least doc_id of the rows reachable by links) and kept (the least row itself).

    Rows without words stand alone.
    """
    found = durable(similarity_join(docs, text, doc_id, **options), "joined")
    least = durable(found.groupBy("_root").agg(F.min(F.struct("_a", "_b")).alias("_least")), "least")
    found = found.join(least, "_root").groupBy("_a", "_b").agg(F.max("_links").alias("_links"), F.first("_least").alias("_least"))
    found = found.select(F.col("_a").alias("_fa"), F.col("_b").alias("_fb"), "_links", "_least")
    slim = _keyed(docs, text, doc_id).select(F.col(doc_id).alias("doc_id"), "_a", "_b")
    out = slim.join(found, (F.col("_a") == F.col("_fa")) & (F.col("_b") == F.col("_fb")), "left")
    own = F.struct("_a", "_b")
    return out.select("doc_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_least").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("_least._a"), F.lit(-(1 << 63)))).alias("component_id"), F.coalesce(F.col("_least") == own, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each linked group: the one with the least doc_id. All columns are kept."""
    plain, names, restored = unclashing(docs)
    text, doc_id = names[text], names[doc_id]
    found = durable(similarity_join(plain, text, doc_id, **options), "joined")
    least = durable(found.groupBy("_root").agg(F.min(F.struct("_a", "_b")).alias("_least")), "least")
    judged = durable(found.join(least, "_root").groupBy("_a", "_b").agg(F.count("*").alias("_rows"), F.first(F.col("_least") == F.struct("_a", "_b")).alias("_kept")), "judged")
    gone = judged.where("NOT _kept").select(F.col("_a").alias("_ga"), F.col("_b").alias("_gb"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    out = _keyed(plain, text, doc_id).join(gone, (F.col("_a") == F.col("_ga")) & (F.col("_b") == F.col("_gb")), "left_anti")
    again = judged.where("_kept AND _rows > 1").select(F.col("_a").alias("_ra"), F.col("_b").alias("_rb"))
    if again.isEmpty():
        return out.select(*restored)
    # Rows repeated outright: all but one of each go, too.
    same = (F.col("_a") == F.col("_ra")) & (F.col("_b") == F.col("_rb"))
    return out.join(again, same, "left_anti").select(*restored).union(out.join(again, same, "left_semi").dropDuplicates(["_a", "_b"]).select(*restored))
