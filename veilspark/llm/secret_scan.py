"""Secrets in texts, all in native expressions: fixed patterns, and weak candidates that count only in company.

Each pattern's matches get code-point offsets from the lengths of the matches and of the gaps between them. Weak candidates
(identifiers, long random-looking strings, endpoints) are then linked by an interval join within scopes. A part vouches for a
candidate if it is disjoint from it and at most `scope` code points away: if it ends in the scope before the candidate's start or
starts in the scope behind its end. So starts and ends are dealt to cells of one scope's width, each cell keeps the least and the
greatest of every kind of part (pre-aggregated), and a candidate looks into two cells on either side: the join is exact and linear
in the spans, and no text's pairs are listed.

Defined results: null text counts as empty; repeated rows give equal results; no rows give no rows; a null doc_id stays null;
columns beside those named are kept, but for assign, access, hex, base and spans, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.core import matches
from veilspark.llm.common import durable, unclashing

#: Fixed patterns, in the order that breaks ties.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")
#: Weak candidates: a named account, a long string of mixed signs, an address with a scheme.
IDENTIFIER = r"""(?i:(?:client|account|user|tenant)[_-]?(?:id|name)|username|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{32,}+={0,2}"
ENDPOINT = r"""(?i:https?|ftp|sftp|ssh|amqps?|redis|mongodb(?:\+srv)?|postgres(?:ql)?|mysql|jdbc:[a-z]+)://[^\x00-\x20"'<>`]+"""


def _tagged(column: str, kind: str) -> Column:
    return F.transform(column, lambda x: F.struct(x["start"].cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["end"].cast("int").alias("end")))


def digest(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


FOUND = ("assign", "access", "hex", "base", "spans")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = 400) -> DataFrame:
    """docs' other columns with assign, access, hex (arrays of start, end, value), base and spans (arrays of start, rank, kind, end, sorted)."""
    plain, names, restored = unclashing(docs)
    kept = [(n, c) for (old, n), c in zip(names.items(), restored, strict=True) if old != text and old not in FOUND]
    t = F.coalesce(F.col(names[text]).cast("string"), F.lit(""))
    keyed = plain.withColumn("_t", t).withColumn("_a", F.coalesce(F.col(names[doc_id]).cast("long"), F.lit(-(1 << 63)))).withColumn("_b", F.xxhash64("_t"))
    found = keyed.select(
        *[n for n, _ in kept],
        "_a",
        "_b",
        F.filter(matches(F.col("_t"), ASSIGN), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= 6).alias("assign"),
        matches(F.col("_t"), ACCESS).alias("access"),
        matches(F.col("_t"), HEX).alias("hex"),
        *[_slim(matches(F.col("_t"), p)).alias(name) for name, p in (("_identifier", IDENTIFIER), ("_opaque", OPAQUE), ("_endpoint", ENDPOINT))],
    )
    found = durable(found.withColumn("_base", F.sort_array(F.concat(*[_tagged(k, k) for k in KINDS[:3]]))), "scanned")
    linked = _linked(found.where("size(_identifier) + size(_opaque) + size(_endpoint) > 0"), scope)
    out = found.join(linked, (F.col("_a") == F.col("_la")) & (F.col("_b") == F.col("_lb")), "left")
    return out.select(*[c for _, c in kept], "assign", "access", "hex", F.col("_base").alias("base"), F.when(F.col("_extra").isNull(), F.col("_base")).otherwise(F.sort_array(F.concat("_base", "_extra"))).alias("spans"))


def _slim(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


#: The parts, by the columns that hold them, and what each weak candidate needs near by: an endpoint tells nothing without both others.
PARTS = {"identifier": ("access", "_identifier"), "secret": ("assign", "hex", "_opaque"), "endpoint": ("_endpoint",)}
NEEDS = {"_identifier": ("secret",), "_opaque": ("identifier",), "_endpoint": ("identifier", "secret")}


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """Per text (_la, _lb) its weak candidates in company, as _extra."""

    def tagged(part: str, name: str) -> Column:
        return F.transform(name, lambda x: F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), x["start"].alias("start"), x["end"].alias("end")))

    rows = found.select("_a", "_b", F.inline(F.concat(*[tagged(part, name) for part, names in PARTS.items() for name in names])))
    points = rows.select("_a", "_b", "part", F.explode(F.array(F.struct(F.lit("end").alias("side"), F.col("end").alias("at")), F.struct(F.lit("start").alias("side"), F.col("start").alias("at")))).alias("_p")).select("_a", "_b", "part", "_p.*")
    edges = [x for p in PARTS for x in (F.min(F.when(F.col("part") == p, F.col("at"))).alias(f"{p}_least"), F.max(F.when(F.col("part") == p, F.col("at"))).alias(f"{p}_most"))]
    cells = points.groupBy(F.col("_a").alias("_ca"), F.col("_b").alias("_cb"), F.col("side").alias("_side"), F.expr(f"at div {scope}").alias("_cell")).agg(*edges)
    # Of the two cells on a side the nearer one must hold a point beyond the candidate, the farther one a point within the scope.
    look = lambda side, cell, low, bound: F.struct(F.lit(side).alias("look"), F.expr(cell).alias("cell"), F.lit(low).alias("low"), F.expr(bound).alias("bound"))
    looks = F.array(
        look("end", f"start div {scope}", True, "start"),
        look("end", f"start div {scope} - 1", False, f"start - {scope}"),
        look("start", f"end div {scope}", False, "end"),
        look("start", f"end div {scope} + 1", True, f"end + {scope}"),
    )
    asked = rows.where(F.col("name").isin(*NEEDS)).withColumn("_look", F.explode(looks)).select("_a", "_b", "name", "start", "end", "_look.*")
    met = asked.join(cells, (F.col("_a") == F.col("_ca")) & (F.col("_b") == F.col("_cb")) & (F.col("look") == F.col("_side")) & (F.col("cell") == F.col("_cell")))
    near = lambda p: F.max(F.when(F.col("low"), F.col(f"{p}_least") <= F.col("bound")).otherwise(F.col(f"{p}_most") >= F.col("bound"))).alias(p)
    judged = met.groupBy("_a", "_b", "name", "start", "end").agg(*[near(p) for p in PARTS])
    test = F.lit(False)
    for name, wanted in NEEDS.items():
        both = F.col("name") == name
        for p in wanted:
            both &= F.coalesce(F.col(p), F.lit(False))
        test |= both
    kind = F.expr("substring(name, 2)")
    rank = F.expr("array_position(array({}), substring(name, 2)) - 1".format(", ".join(f"'{k}'" for k in KINDS))).cast("int")
    return judged.where(test).groupBy(F.col("_a").alias("_la"), F.col("_b").alias("_lb")).agg(F.collect_set(F.struct(F.col("start"), rank.alias("rank"), kind.alias("kind"), F.col("end"))).alias("_extra"))
