"""Which layers run, and in what chunks, by type and size of a file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.core import col


@dataclass(frozen=True)
class Plan:
    rule: str
    use_regex: bool
    use_spacy: bool
    use_bert: bool
    spacy_model: str
    chunk_size: int
    workers: int


def plan_for(file_type: str, size_mb: float) -> Plan:
    """A: structured, B: large texts, C: small texts, D: images. Unknown types raise ValueError."""
    t = file_type.lower().lstrip(".")
    if t in fixed.IMAGES:
        return Plan("D", True, False, False, "en_core_web_sm", fixed.GRID * fixed.GRID, 8)
    if t in fixed.STRUCTURED:
        return Plan("A", True, False, False, "en_core_web_sm", fixed.CHUNKS_STRUCTURED[t], 8)
    if t in fixed.UNSTRUCTURED:
        if size_mb > fixed.CHUNK_MB:
            return Plan("B", True, True, False, "en_core_web_sm", fixed.CHUNKS_LARGE[t], 4)
        return Plan("C", True, True, True, "en_core_web_trf", fixed.CHUNKS_SMALL[t], 4)
    raise ValueError(f"unknown file type: {file_type!r}")


def plan_column(file_type: Column | str, size_mb: Column | str) -> Column:
    """The same as a struct per row; null for unknown types."""
    t, out = F.regexp_replace(F.lower(col(file_type)), r"^\.+", ""), F.lit(None)
    for kind in (*fixed.IMAGES, *fixed.STRUCTURED, *fixed.UNSTRUCTURED):
        small, large = plan_for(kind, 0.0), plan_for(kind, fixed.CHUNK_MB + 1)
        own = F.when(col(size_mb) > fixed.CHUNK_MB, _struct(large)).otherwise(_struct(small)) if small != large else _struct(small)
        out = F.when(t == kind, own).otherwise(out)
    return out


def _struct(p: Plan) -> Column:
    return F.struct(F.lit(p.rule).alias("rule"), F.lit(p.use_regex).alias("use_regex"), F.lit(p.use_spacy).alias("use_spacy"), F.lit(p.use_bert).alias("use_bert"), F.lit(p.spacy_model).alias("spacy_model"), F.lit(p.chunk_size).alias("chunk_size"), F.lit(p.workers).alias("workers"))
