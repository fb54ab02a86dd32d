"""Tables of strings: each column of a chunk of rows is one text to detect in, and its values are masked cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.core import SPAN
from veilspark.operators.chunking import chunk_of, head_sample, with_row_index
from veilspark.operators.context import column_boost
from veilspark.operators.detect import pattern_spans
from veilspark.operators.masking import replace_many, value_map
from veilspark.operators.resolve import dedup_same_type

SEPARATOR = " | "
#: The row number while it stands beside columns of any name.
ROW = "_row_idx"


def gathered(df: DataFrame, columns: list[str], index: str = "row_idx", rows: int = 10_000) -> DataFrame:
    """(chunk, column, cells, order, rest): one row per column of each chunk, with the column's values in row order.

    A chunk bounds what meets in a task. order (the row numbers) and rest (each row's other columns) stand with the first column only.
    """
    others = [F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(df.columns) if c not in (index, *columns)]
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    row = F.struct(F.col(index).alias("at"), F.struct(*[cell(c).alias(f"_{i}") for i, c in enumerate(columns)]).alias("cells"), F.struct(F.lit(0).alias("_"), *others).alias("rest"))
    wide = df.groupBy(chunk_of(index, rows).alias("chunk")).agg(F.collect_list(row).alias("_all"))
    # Other columns may be of kinds that have no order, so row numbers alone are sorted.
    wide = wide.withColumn("_by", F.sort_array(F.transform("_all", lambda r, i: F.struct(r["at"].alias("at"), i.alias("i")))))
    wide = wide.select("chunk", F.transform("_by", lambda o: F.get(F.col("_all"), o["i"])).alias("_all"))
    of = lambda what, first: what if first else F.lit(None)
    each = [F.struct(F.lit(c).alias("column"), F.col(f"_all.cells._{i}").alias("cells"), of(F.col("_all.at"), i == 0).alias("order"), of(F.col("_all.rest"), i == 0).alias("rest")) for i, c in enumerate(columns)]
    return wide.select("chunk", F.inline(F.array(*each)))


def column_texts(df: DataFrame, columns: list[str], index: str = "row_idx", rows: int = 10_000, sample: int | None = None) -> DataFrame:
    """(chunk, column, text): the values of each column of each chunk, in row order. sample: of the first rows of a chunk only."""
    slim = df.select(index, *[F.col(f"`{c}`") for c in columns])
    slim = slim.where(head_sample(index, rows, sample)) if sample else slim
    return gathered(slim, columns, index, rows).select("chunk", "column", F.array_join("cells", SEPARATOR).alias("text"))


def column_detections(texts: DataFrame, context: bool = False) -> DataFrame:
    """texts with their spans; with context, the column's name lifts spans of its type."""
    spans = texts.withColumn("spans", dedup_same_type(pattern_spans("text")))
    if not context:
        return spans
    names = [r[0] for r in texts.select("column").distinct().collect()]
    out = F.col("spans")
    for name in names:
        out = F.when(F.col("column") == name, column_boost(F.col("spans"), name)).otherwise(out)
    return spans.withColumn("spans", out.cast(f"array<{SPAN}>"))


def sanitize_table(df: DataFrame, mode: str = "redact", columns: list[str] | None = None, rows: int = fixed.CHUNKS_STRUCTURED["csv"], sample: int | None = None, min_score: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(masked table in row order, detections per chunk and column). sample limits detection to the head of each chunk; by default all rows count."""
    columns = columns or df.columns
    indexed = with_row_index(df, ROW)
    cells = gathered(indexed, columns, ROW, rows)
    seen = F.col("cells") if sample is None else F.slice("cells", 1, sample)
    found = column_detections(cells.withColumn("text", F.array_join(seen, SEPARATOR)))
    entries = found.withColumn("_entries", value_map(F.filter("spans", lambda s: s["score"] >= min_score), mode))
    masked = entries.select("chunk", "column", "order", "rest", replace_many(F.col("cells"), F.col("_entries"), "once").alias("cells"))
    # The rows of a chunk stand together already: nothing is shuffled again.
    pick = lambda c, what: F.first(F.when(F.col("column") == c, F.col(what)), ignorenulls=True)
    whole = masked.groupBy("chunk").agg(pick(columns[0], "order").alias("order"), pick(columns[0], "rest").alias("rest"), *[pick(c, "cells").alias(f"_{i}") for i, c in enumerate(columns)])
    out = whole.select(F.inline(F.arrays_zip("order", "rest", *[f"_{i}" for i in range(len(columns))])))
    own = {c: F.col(f"_{i}") for i, c in enumerate(columns)}
    kept: list[Column] = [(own[c] if c in own else F.col(f"rest._r{i}")).alias(c) for i, c in enumerate(df.columns)]
    return out.select(F.col("order").alias("row_idx"), *kept), found.select("chunk", "column", "text", "spans")
