"""Near-duplicate embeddings by NN-descent.

A neighbour graph over the vectors of each label starts from leaves of random-projection trees and is refined: each vector brings
its neighbours, forward and reverse, together, and they learn of each other (neighbours of neighbours). Neighbours that meet at a
hub are dealt into blocks, so no group outgrows a task. A list whose entries all pass the threshold is saturated: there may be more.
It is enlarged to everything reachable through passing entries, and that closure is compared block by block, in double precision,
as matrix products; a row is written per vector and block, never per pair. A link that lists of any length leave out has saturated
lists at both ends, so each closure's saturated vectors get a ball around one of them, and closures whose balls come within the
threshold's angle of each other are compared as one: nothing is cut, however large the groups are.

The trees are as many as a pair at the threshold needs to meet in one leaf, which grows with the logarithm of the largest label, and
rounds go on until the lists hardly change. A bounded sample of vectors is compared with all others to audit recall, per vector and by
number of links, so that large groups do not hide small ones; while it falls short, new trees and longer lists are added, and if it
still falls short after `passes` of them every label is compared as one closure, block by block, which is exact. The figures of each
audit are given to the caller.

Equal vectors of one label are one node from the start. Defined results: a vector that is null, empty, zero or has null or
non-finite components, or whose label is null, links with nothing and is its own component; repeated rows link with each other; a
null vec_id takes part, but names no component; no rows give no rows; other columns are ignored. Vectors of unequal length never
link.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import components, durable, mapped

#: Recall the audit asks for in each stratum, the share of new entries at which lists count as settled, and the share of pairs at the
#: threshold that may meet in no leaf.
WANTED, SETTLED, MISSED = 0.97, 0.001, 0.001


def _units(rows: list, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one."""
    good = [r is not None and len(r) > 0 and None not in r for r in rows]
    out = [np.array(r if g else [], float) for r, g in zip(rows, good, strict=True)]
    good = np.array([g and bool(np.isfinite(v).all()) and 0 < float(np.abs(v).max()) for g, v in zip(good, out, strict=True)], bool)
    return out, good


def nodes_of(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, _k (label and vector as a key; null where it cannot link), _group (label and length) and _v (unit vector, doubles)."""

    def run(batches):
        for batch in batches:
            rows, labels = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            vectors, good = _units(rows)
            keys, groups, units = [], [], []
            for v, g, name in zip(vectors, good, labels, strict=True):
                if not g or name is None:
                    keys.append(None), groups.append(None), units.append(None)
                    continue
                v = v / np.abs(v).max()  # else squares of very large or small components overflow or vanish
                unit = v / np.sqrt((v * v).sum())
                groups.append(f"{name}/{len(v)}")
                units.append(unit.astype("<f8").tobytes())
                keys.append(hashlib.blake2b(groups[-1].encode() + b"\0" + units[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(groups, pa.string()), pa.array(units, pa.binary())], names=["vec_id", "_k", "_group", "_v"])

    return mapped(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("_e"), F.col(label).cast("string").alias("_l")), run, "vec_id long, _k binary, _group string, _v binary")


def _matrix(values: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64 if kind == "<f8" else np.float32)


def _best(keys: list[bytes], sims: np.ndarray, most: int) -> tuple[list, list, list]:
    """Per row its `most` likest others: (key, other, similarity)."""
    np.fill_diagonal(sims, -2)
    most = min(most, len(keys) - 1)
    if most <= 0:
        return [], [], []
    at = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    row = np.repeat(np.arange(len(keys)), most)
    return [keys[i] for i in row], [keys[i] for i in at.reshape(-1)], sims[row, at.reshape(-1)].tolist()


EDGES = "u binary, v binary, sim double"


def _edges(u: list, v: list, sim: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(sim, pa.float64())], names=["u", "v", "sim"])


def _planted(nodes: DataFrame, trees: int, leaf: int, most: int, seed: int) -> DataFrame:
    """First edges: neighbours within leaves of random-projection trees, cut from the sorted order of sign codes."""

    def codes(batches):
        for batch in batches:
            out: list[tuple] = []
            for k, group, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                x = np.frombuffer(v, "<f8")
                planes = np.random.default_rng(seed + len(x)).standard_normal((trees * 24, len(x))) if len(x) not in known else known[len(x)]
                known[len(x)] = planes
                bits = (planes @ x > 0).reshape(trees, 24) @ (1 << np.arange(23, -1, -1))
                out += [(t, group, int(bits[t]), k, x.astype("<f2").tobytes()) for t in range(trees)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["tree", "group", "code", "k", "v"])

    known: dict[int, np.ndarray] = {}

    def leaves(batches):
        held: list[tuple] = []

        def flush():
            u, v, s = _best([x[1] for x in held], (m := _matrix([x[2] for x in held], "<f2")) @ m.T, most)
            return _edges(u, v, s)

        for batch in batches:
            for tree, group, k, v in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
                if held and (held[0][0] != (tree, group) or len(held) >= leaf):
                    yield flush()
                    held.clear()
                held.append(((tree, group), k, v))
        if held:
            yield flush()

    dealt = mapped(nodes.select("_k", "_group", "_v"), codes, "tree int, group string, code int, k binary, v binary")
    return mapped(dealt.repartitionByRange("tree", "group", "code", "k").sortWithinPartitions("tree", "group", "code", "k"), leaves, EDGES)


def trees_for(size: int, threshold: float, leaf: int) -> int:
    """Trees after which all but a share MISSED of pairs at the threshold have met in a leaf, in a label of `size` vectors.

    A random plane keeps such a pair together with probability 1 - angle / pi; about a third of pairs that share the bits of a leaf
    are parted by its edges.
    """
    bits = max(0.0, np.log2(max(size, 1) / leaf))
    met = 0.7 * (1 - np.arccos(threshold) / np.pi) ** (bits + 1)
    return int(np.ceil(np.log(MISSED) / np.log(1 - met))) if size > leaf else 1


def _lists(edges: DataFrame, most: int) -> DataFrame:
    """Each vector's `most` likest neighbours, as edges; lists of several tasks are merged from their best entries."""
    best = F.slice(F.sort_array(F.collect_set(F.struct("sim", "v")), asc=False), 1, most)
    # An edge set is first cut per salt, so that no vector's candidates meet in one task before they are few.
    part = edges.groupBy("u", F.pmod(F.xxhash64("v"), F.lit(8)).alias("_salt")).agg(best.alias("_own"))
    return part.select("u", F.inline("_own")).groupBy("u").agg(best.alias("_own")).select("u", F.inline("_own")).select("u", "v", "sim")


def _refined(edges: DataFrame, nodes: DataFrame, most: int, block: int = 64) -> DataFrame:
    """Neighbours of each vector meet and learn of each other; the lists are cut again to their best."""

    def meet(table: pa.Table) -> pa.Table:
        keys = table.column("_k").to_pylist()
        m = _matrix(table.column("_h").to_pylist(), "<f2")
        return pa.Table.from_batches([_edges(*_best(keys, m @ m.T, most))])

    # u is sent to the place `at`: its neighbour's and its own.
    sent = edges.select(F.col("u"), F.col("v").alias("at")).union(edges.select(F.col("v"), F.col("u").alias("at"))).union(edges.select("u", F.col("u").alias("at"))).distinct()
    sent = durable(sent, "sent")
    crowd = durable(sent.groupBy("at").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")), "crowd")
    placed = sent.join(crowd, "at").withColumn("_block", F.pmod(F.xxhash64("u"), F.col("_blocks")))
    half = nodes.select("_k", "_h")
    fresh = placed.join(half, F.col("u") == F.col("_k")).select("at", "_block", "_k", "_h").groupBy("at", "_block").applyInArrow(meet, EDGES)
    return _lists(edges.union(fresh), most)


def _compare(threshold: float):
    """A pair of blocks of one closure: per vector its links and the least vector that it reaches here."""

    def run(table: pa.Table) -> pa.Table:
        keys, times, block = table.column("_k").to_pylist(), table.column("_times").to_numpy().astype(np.int64), table.column("_block").to_numpy()
        m = _matrix(table.column("_v").to_pylist(), "<f8")
        near = m @ m.T >= threshold
        np.fill_diagonal(near, False)
        if table.column("_lo")[0].as_py() != table.column("_hi")[0].as_py():
            near &= block[:, None] != block[None, :]
        rank = np.argsort(np.array(sorted(range(len(keys)), key=keys.__getitem__)))
        order, label = np.argsort(rank), rank.copy()
        while True:
            least = np.minimum(label, np.where(near, label[None, :], len(keys)).min(axis=1))
            if (least == label).all():
                break
            label = least
        hit = np.flatnonzero(near.any(axis=1))
        return pa.table({"_k": pa.array([keys[i] for i in hit], pa.binary()), "_links": (near @ times)[hit].astype(np.int64), "_root": pa.array([keys[order[label[i]]] for i in hit], pa.binary())})

    return run


def _touching(threshold: float):
    """A pair of blocks of balls: per ball the least one that it reaches here, each step between balls that a link may cross."""

    def run(table: pa.Table) -> pa.Table:
        roots = table.column("root").to_pylist()
        radius = table.column("_radius").to_numpy()
        m = _matrix(table.column("_centre").to_pylist(), "<f8")
        near = np.arccos(np.clip(m @ m.T, -1, 1)) <= radius[:, None] + radius[None, :] + np.arccos(threshold) + 1e-6
        order = np.array(sorted(range(len(roots)), key=roots.__getitem__))
        label = np.argsort(order)
        while True:
            least = np.minimum(label, np.where(near, label[None, :], len(roots)).min(axis=1))
            if (least == label).all():
                break
            label = least
        return pa.table({"a": pa.array(roots, pa.binary()), "b": pa.array([roots[order[i]] for i in label], pa.binary())})

    return run


def _joined(closed: DataFrame, passing: DataFrame, nodes: DataFrame, threshold: float, most: int, block: int) -> DataFrame:
    """closed (node, root) with closures made one where their saturated vectors may link."""

    def angles(batches):
        for batch in batches:
            v, c = (batch.column(i).to_pylist() for i in (2, 3))
            at = [float(np.arccos(np.clip(np.frombuffer(a, "<f8") @ np.frombuffer(b, "<f8"), -1, 1))) for a, b in zip(v, c, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(at, pa.float64())], names=["root", "_group", "_centre", "_radius"])

    full = passing.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= most)
    own = durable(full.join(closed, F.col("u") == F.col("node")).select("root", "node"), "saturated")
    vectors = nodes.select(F.col("_k").alias("node"), "_group", "_v")
    centres = own.groupBy("root").agg(F.min("node").alias("node")).join(vectors, "node").select("root", F.col("_v").alias("_centre"))
    balls = mapped(own.join(vectors, "node").join(centres, "root").select("root", "_group", "_v", "_centre"), angles, "root binary, _group string, _centre binary, _radius double")
    balls = durable(balls.groupBy("root").agg(F.first("_group").alias("_group"), F.first("_centre").alias("_centre"), F.max("_radius").alias("_radius")), "balls")
    size = balls.groupBy("_group").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    placed = balls.join(size, "_group").withColumn("_block", F.pmod(F.xxhash64("root"), F.col("_blocks")).cast("int"))
    placed = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_lo", F.least("_block", "_with")).withColumn("_hi", F.greatest("_block", "_with"))
    met = placed.select("_group", "_lo", "_hi", "root", "_centre", "_radius").groupBy("_group", "_lo", "_hi").applyInArrow(_touching(threshold), "a binary, b binary")
    merged = components(met).select(F.col("node").alias("_old"), F.col("root").alias("_new"))
    return closed.join(merged, F.col("root") == F.col("_old"), "left").select("node", F.coalesce("_new", "root").alias("root"))


def _closures(edges: DataFrame, nodes: DataFrame, threshold: float, block: int, most: int) -> DataFrame:
    """Per vector and pair of blocks of its closure: _k, _links, _root."""
    passing = edges.where(F.col("sim") >= threshold - 0.004)  # half precision may be off by that much
    closed = durable(components(passing.select(F.col("u").alias("a"), F.col("v").alias("b"))), "closed")
    return _compared(durable(_joined(closed, passing, nodes, threshold, most, block), "closed"), nodes, threshold, block)


def _compared(closed: DataFrame, nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """All pairs of blocks of each closure (node, root): _k, _links, _root."""
    # Written, so that the join is one of two plain shuffles, which Spark splits where a closure is large; so below.
    size = durable(closed.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")), "sizes")
    placed = closed.join(size, "root").withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    placed = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_lo", F.least("_block", "_with")).withColumn("_hi", F.greatest("_block", "_with"))
    placed = placed.select("root", "node", "_block", "_lo", "_hi").join(nodes.select("_k", "_v", "_times"), F.col("node") == F.col("_k"))
    return durable(placed.groupBy("root", "_lo", "_hi").applyInArrow(_compare(threshold), "_k binary, _links long, _root binary"), "near")


def audit(nodes: DataFrame, links: DataFrame, threshold: float, queries: int) -> dict[int, float]:
    """Mean share of its own true links that a vector of a sample found, by the bit length of the number of its links.

    The sample has `queries` vectors at most, chosen by a hash.
    """
    n = nodes.count()
    # orderBy().limit() keeps the least of each task, so one row per query reaches the driver.
    sample = nodes.orderBy(F.xxhash64("_k"), "_k").limit(min(queries, n)).select("_k", "_group", "_v").collect()
    if not sample:
        return {}
    by: dict[str, list] = {}
    for r in sample:
        by.setdefault(r["_group"], []).append((bytes(r["_k"]), bytes(r["_v"])))
    shared = nodes.sparkSession.sparkContext.broadcast({g: ([k for k, _ in own], np.stack([np.frombuffer(v, "<f8") for _, v in own])) for g, own in by.items()})

    def run(batches):
        for batch in batches:
            keys, groups, vectors = (batch.column(c).to_pylist() for c in range(3))
            times = batch.column(3).to_numpy().astype(np.int64)
            out: dict[bytes, int] = {}
            for g, (own, m) in shared.value.items():
                at = [i for i, x in enumerate(groups) if x == g]
                if at:
                    near = m @ _matrix([vectors[i] for i in at], "<f8").T >= threshold
                    same = np.array([[a == keys[i] for i in at] for a in own])
                    for a, x in zip(own, (near & ~same) @ times[at], strict=True):
                        out[a] = out.get(a, 0) + int(x)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.int64())], names=["_q", "_true"])

    true = mapped(nodes.select("_k", "_group", "_v", "_times"), run, "_q binary, _true long").groupBy("_q").agg(F.sum("_true").alias("_true"))
    # One row per query at most.
    own = true.where("_true > 0").join(links, F.col("_q") == F.col("_k"), "left").select("_true", F.least("_true", F.coalesce("_links", F.lit(0))).alias("_found")).collect()
    strata: dict[int, list[float]] = {}
    for r in own:
        strata.setdefault(int(r["_true"]).bit_length(), []).append(r["_found"] / r["_true"])
    return {k: sum(x) / len(x) for k, x in sorted(strata.items())}


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", most: int = 8, trees: int = 4, leaf: int = 64, rounds: int = 1, block: int = 512, queries: int = 500, passes: int = 4, report: list | None = None) -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id, kept.

    report, where given, gets the recall of each pass (see `audit`), and None for the exact comparison, if it came to that.
    """
    rows = durable(nodes_of(vectors, vec_id, embedding, label), "vectors")

    def halved(batches):
        for batch in batches:
            h = [np.frombuffer(v, "<f8").astype("<f2").tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h, pa.binary())], names=["_k", "_group", "_v", "_times", "_h"])

    nodes = rows.where("_k IS NOT NULL").groupBy("_k").agg(F.first("_group").alias("_group"), F.first("_v").alias("_v"), F.count("*").alias("_times"))
    nodes = durable(mapped(nodes, halved, "_k binary, _group string, _v binary, _times long, _h binary"), "nodes")
    largest = nodes.groupBy("_group").count().agg(F.max("count")).first()[0] or 0
    trees = max(trees, trees_for(largest, threshold, leaf))
    edges = durable(_lists(_planted(nodes, trees, leaf, most, 17), most), "graph")
    for refined in range(1, passes + 1):
        done = 0
        while True:
            before, edges = edges, durable(_refined(edges, nodes, most), "graph")
            done += 1
            if done >= rounds and edges.join(before, ["u", "v"], "left_anti").count() <= SETTLED * edges.count():
                break
        found = _closures(edges, nodes, threshold, block, most)
        links = found.groupBy("_k").agg(F.sum("_links").alias("_links"))
        recall = audit(nodes, links, threshold, queries)
        if report is not None:
            report.append(recall)
        if min(recall.values(), default=1.0) >= WANTED:
            break
        most *= 2
        edges = durable(_lists(edges.union(_planted(nodes, trees, leaf, most, 17 + 1000 * refined)), most), "graph")
    else:
        first = durable(nodes.groupBy("_group").agg(F.min("_k").alias("root")), "labels")
        found = _compared(durable(nodes.select(F.col("_k").alias("node"), "_group").join(first, "_group").select("node", "root"), "closed"), nodes, threshold, block)
        links = found.groupBy("_k").agg(F.sum("_links").alias("_links"))
        if report is not None:
            report.append(None)
    roots = components(found.select(F.col("_k").alias("a"), F.col("_root").alias("b")))
    info = nodes.select("_k", "_times").join(links, "_k", "left").join(roots, F.col("_k") == F.col("node"), "left")
    info = info.select(F.col("_k").alias("_class"), (F.coalesce("_links", F.lit(0)) + F.col("_times") - 1).alias("_links"), F.coalesce("root", "_k").alias("_root"))
    info = durable(info, "classes")
    # The least id of each class first, so that a component meets by classes and not by rows.
    own = rows.where("_k IS NOT NULL").groupBy("_k").agg(F.min("vec_id").alias("_own"))
    least = durable(info.join(own, F.col("_k") == F.col("_class")).groupBy("_root").agg(F.min("_own").alias("_least")), "least")
    named = durable(info.join(least, "_root"), "named")
    out = rows.select("vec_id", "_k").join(named, F.col("_k") == F.col("_class"), "left")
    component = F.coalesce("_least", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
