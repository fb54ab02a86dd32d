"""Counts by type, layer and confidence, per text and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.core import col, let, rows_of
from veilspark.operators.resolve import tier


def long_form(docs: DataFrame, spans: str, *keys: str) -> DataFrame:
    """One row per span, beside the key columns."""
    return rows_of(docs, spans, *keys)


def type_summary(spans: DataFrame, *keys: str) -> DataFrame:
    return spans.groupBy(*keys, "entity_type").agg(F.count("*").alias("n"))


def layer_breakdown(spans: DataFrame, *keys: str, layers: tuple[str, ...] = ("regex", "presidio_spacy", "indic_bert"), other: str | None = "presidio_spacy") -> DataFrame:
    """A column of counts per known layer; unknown ones count as `other`."""
    known = F.col("layer").isin(*layers)
    own = [F.count_if((F.col("layer") == x) | (~known if x == other else F.lit(False))).alias(x) for x in layers]
    return spans.groupBy(*keys).agg(*own)


def confidence_breakdown(spans: DataFrame, *keys: str) -> DataFrame:
    t = tier(F.col("score"), F.col("standalone_non_pii"))
    return spans.groupBy(*keys).agg(F.count_if(t == "high").alias("high_confidence"), F.count_if(t == "medium").alias("medium_confidence"))


def counts_by(array: Column, field: str) -> Column:
    """map(value of the field, count) of an array of structs, by first appearance."""
    return let(F.transform(array, lambda s: s[field]), lambda values: F.map_from_entries(F.transform(F.array_distinct(values), lambda v: F.struct(v, F.size(F.filter(values, lambda x: x == v)).cast("bigint")))))


def summary(spans: Column | str, layers: tuple[str, ...] = ("regex", "spacy", "bert")) -> Column:
    """struct(pii_summary, layer_breakdown, high, medium, total) of an array of spans; spans under 0.60 count in the total alone."""
    s = col(spans)
    zero = F.create_map(*[x for name in layers for x in (F.lit(name), F.lit(0).cast("bigint"))])
    merged = F.map_zip_with(zero, counts_by(s, "layer"), lambda k, a, b: F.coalesce(b, a))
    return F.struct(
        counts_by(s, "entity_type").alias("pii_summary"),
        merged.alias("layer_breakdown"),
        F.size(F.filter(s, lambda x: x["score"] >= fixed.HIGH)).cast("bigint").alias("high"),
        F.size(F.filter(s, lambda x: (x["score"] >= fixed.MEDIUM) & (x["score"] < fixed.HIGH))).cast("bigint").alias("medium"),
        F.size(s).cast("bigint").alias("total"),
    )


def merge_summaries(chunks: DataFrame, map_column: str, *keys: str, success: str = "success", seed: tuple[str, ...] = ()) -> DataFrame:
    """Sum per key of a map column over chunks that succeeded; `seed` keys are there even at zero."""
    good = chunks.where(F.col(success))
    rows = good.select(*keys, F.explode(map_column).alias("key", "value"))
    if seed:
        rows = rows.unionByName(chunks.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, seed))).alias("key"), F.lit(0).cast("bigint").alias("value")))
    return rows.groupBy(*keys, "key").agg(F.sum("value").alias("value"))


def chunk_status(chunks: DataFrame, *keys: str, state: str = "state") -> DataFrame:
    """Counts by state, percent (half to even), weighted progress (done 100, processing 50)."""
    n = F.count("*")
    of = lambda s: F.count_if(F.col(state) == s)
    return chunks.groupBy(*keys).agg(
        n.alias("total"), of("done").alias("done"), of("failed").alias("failed"), of("processing").alias("processing"), of("pending").alias("pending"),
        F.bround(100 * of("done") / n, 0).cast("int").alias("percent"),
        F.floor((100 * of("done") + 50 * of("processing")) / n + 0.5).cast("int").alias("progress"),
    )


def succeeded(parts: DataFrame, *keys: str, failed: str = "failed", extra: str = "exif_count") -> DataFrame:
    """A job fails only if all its parts did and nothing else was found."""
    return parts.groupBy(*keys).agg((~(F.bool_and(failed) & (F.coalesce(F.sum(extra), F.lit(0)) == 0))).alias("success"), F.count_if(failed).alias("failed_parts"), F.sum(extra).alias("extra"))


def seconds_left(done: Column | str, total: Column | str, elapsed: Column | str) -> Column:
    """What is left at the rate so far; null before the first is done."""
    return F.when(col(done) > 0, (col(total) - col(done)) * col(elapsed) / col(done))
