"""Quality scores by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are maximal runs of letters, digits and other non-ASCII bytes, and maximal runs of other signs; single tokens and pairs of
neighbours are hashed to 2**bits places. A document's features are their counts over the root of how many there are, so its score
is a sparse dot product, worked out over whole texts for a slice of documents at once.

The learner sees a bounded, documented sample of labelled rows (max_rows), dealt to a fixed number of shards by a hash of the id, so
that files and tasks have no part in it; each shard runs the per-coordinate updates over its rows, in the order of the hash, for some
rounds, and the shards' weights are averaged by rows. At most 2**bits weights per shard leave
the executors, whatever the corpus.

Defined results: a null or empty text scores as a text without features; without labelled rows every score is 0.5; repeated rows
each get a score; of several labels of one document the highest counts. Columns beside those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import SPACES, bounded_sample, flat, mapped, mix, prefix_sums, slices, span_hashes

_BYTE = np.arange(256)
#: 0: parts tokens; 1: letters, digits, non-ASCII; 2: signs.
KIND = np.where(SPACES | (_BYTE < 0x20), 0, np.where((_BYTE >= 128) | np.isin(_BYTE, [*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]), 1, 2)).astype(np.uint8)

SAME_AS_FIRST, SAME_AS_SECOND = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def features(b: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of all features of the texts, and where each text's features start (one more than texts)."""
    kind = KIND[b]
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.ones(len(b) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    h = span_hashes(prefix_sums(b), start, end)
    first = np.searchsorted(start, offsets)  # of each text's tokens
    pair = np.zeros(len(h), np.uint64)
    pair[1:] = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    # Pairs that repeat the token before, or the one before that, share one place each: which token it is tells little.
    heads = first[:-1][first[:-1] < first[1:]]
    second = np.zeros(len(h), bool)
    second[2:] = h[2:] == h[:-2]
    second[heads[heads + 1 < len(h)] + 1] = False  # the one before that is of another text
    pair[second] = SAME_AS_SECOND
    pair[1:][h[1:] == h[:-1]] = SAME_AS_FIRST
    places = np.empty(2 * len(h), np.int64)
    places[0::2] = (h >> np.uint64(64 - bits)).astype(np.int64)
    places[1::2] = (pair >> np.uint64(64 - bits)).astype(np.int64)
    # A text's first token has no pair: it counts twice instead.
    places[2 * heads + 1] = places[2 * heads]
    return places, 2 * first


def counted(places: np.ndarray, first: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its places, the bias's last, and their values: counts over the root of how many features it has."""
    out = []
    for a, b in zip(first, first[1:], strict=False):
        at, n = np.unique(places[a:b], return_counts=True)
        out.append((np.append(at, 1 << bits), np.append(n / np.sqrt(max(1, b - a)), 1.0)))
    return out


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, rounds: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights (the last is the bias) after per-coordinate updates over rows of (places, values)."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(0)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            i, x = rows[k]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[k]) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return weights(np.arange(size))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_rows: int = 6000, shards: int = 4, bits: int = 18, rounds: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.2, l2: float = 0.5) -> np.ndarray:
    """Weights from about max_rows labelled documents at most."""
    own = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("double").alias("_label"))
    own = bounded_sample(own, "_id", max_rows)
    # The sample is bounded by max_rows, so it may be broadcast.
    sample = docs.select(F.col(doc_id).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(own), F.col("_key") == F.col("_id")).select("_text", "_label", F.xxhash64(F.lit(5), F.col("_id")).alias("_order"))
    dealt = sample.withColumn("_shard", F.pmod("_order", F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        # A shard holds about max_rows / shards rows.
        table, rows = table.sort_by([("_order", "ascending"), ("_text", "ascending")]), []
        data, offsets = flat(table.column("_text"))
        for i, j in slices(offsets):
            rows += counted(*features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits), bits)
        w = follow_leader(rows, table.column("_label").to_numpy(), bits, rounds, alpha, beta, l1, l2)
        at = np.flatnonzero(w)
        # The row of place -1 counts the shard's rows, even if no weight is left.
        return pa.table({"place": pa.array(np.append(at, -1).astype(np.int32)), "w": pa.array(np.append(w[at] * len(rows), len(rows)))})

    found = dealt.groupBy("_shard").applyInArrow(run, "place int, w double").groupBy("place").agg(F.sum("w").alias("w")).collect()
    w, total = np.zeros((1 << bits) + 1), 1.0
    for place, x in found:
        if place < 0:
            total = x
        else:
            w[place] = x
    return w / total


def score(docs: DataFrame, w: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs, score and predicted."""
    bits = int(np.log2(len(w) - 1))
    frame = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        w = shared.value
        for batch in batches:
            data, offsets = flat(batch.column(len(keep)))
            out = np.zeros(batch.num_rows)
            for i, j in slices(offsets):
                places, first = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                sums = np.concatenate([[0.0], np.cumsum(w[places])])
                out[i:j] = (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(1, np.diff(first)))
            p = 1 / (1 + np.exp(-np.clip(out + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*[f"_k{i}" for i in range(len(keep))], "score", "predicted"])

    schema = ", ".join(f"{c} {t}" for c, t in frame.dtypes[: len(keep)])
    return mapped(frame, run, f"{schema}, score double, predicted int").select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted")
