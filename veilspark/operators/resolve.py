"""Overlap resolution and tiers. The folds keep the order of acceptance, which no window or self-join would."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.core import empty, let, lookup, running, taken


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


#: What a fold looks at: copies of whole spans are dear, and each step makes some.
KEY = "struct<start:int,place:int,end:int,score:double,kind:string,rank:int>"


def _fold(spans: Column, meets, beats, kind=lambda s: F.lit(""), rank=lambda s: F.lit(0)) -> Column:
    """Spans by start; each is compared with the first accepted one that it meets, and takes its place if it beats it.

    Spans are parted where one starts behind the ends of all before it: none meets across such a place, so each part is folded on its own.
    """

    def step(acc: Column, x: Column) -> Column:
        def placed(hit: Column) -> Column:
            better = beats(x, F.get(acc, hit - 1))
            return F.when(hit == 0, F.concat(acc, F.array(x))).when(better, F.transform(acc, lambda a, i: F.when(i == hit - 1, x).otherwise(a))).otherwise(acc)

        return let(F.coalesce(F.array_position(F.transform(acc, lambda a: meets(x, a)), F.lit(True)), F.lit(0)).cast("int"), placed)

    def resolved(part: Column) -> Column:
        accepted = F.aggregate(part, empty(KEY), step)
        # By start again; spans of one start stay in the order of acceptance.
        return F.transform(F.sort_array(F.transform(accepted, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["place"].alias("place")))), lambda x: x["place"])

    def parted(keys: Column) -> Column:
        """Places of the spans that stay."""

        def cut(reach: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: (i == 0) | (F.get(keys, i)["start"] >= F.get(reach, i - 1)))
            parts = lambda at: F.transform(at, lambda i, k: taken(keys, i, F.coalesce(F.get(at, k + 1), F.size(keys)) - i))
            # Where the first meets all others and none beats it, it alone stays.
            alone = lambda part: F.forall(part, lambda s: meets(s, part[0]) & ~beats(s, part[0]))
            return F.flatten(F.transform(let(heads, parts), lambda part: F.when((F.size(part) == 1) | alone(part), F.array(part[0]["place"])).otherwise(resolved(part))))

        return let(running(F.transform(keys, lambda s: s["end"]), F.greatest), cut)

    def stay(own: Column) -> Column:
        keys = F.transform(own, lambda s, i: F.struct(s["start"].alias("start"), i.cast("int").alias("place"), s["end"].alias("end"), s["score"].alias("score"), kind(s).alias("kind"), rank(s).cast("int").alias("rank")))
        return F.when(F.size(own) < 2, own).otherwise(F.transform(let(keys, parted), lambda place: F.get(own, place)))

    return let(F.sort_array(spans), stay)


def dedup_any_type(spans: Column) -> Column:
    """Overlapping spans of whatever type: the higher score stays, the earlier one on a tie."""
    return _fold(spans, _overlaps, lambda x, a: x["score"] > a["score"])


def dedup_same_type(spans: Column) -> Column:
    """Overlapping spans of one type: the higher score stays; on a tie the layer decides, then the earlier one."""
    rank = lambda s: lookup(s["layer"], {k: str(v) for k, v in fixed.LAYER_PRIORITY.items()}, F.lit("0")).cast("int")
    meets, beats = lambda x, a: (x["kind"] == a["kind"]) & _overlaps(x, a), lambda x, a: (x["score"] > a["score"]) | ((x["score"] == a["score"]) & (x["rank"] > a["rank"]))
    return _fold(spans, meets, beats, lambda s: s["entity_type"], rank)


def tier(score: Column, standalone: Column) -> Column:
    return F.when(standalone | (score < fixed.MEDIUM), "low").when(score >= fixed.HIGH, "high").otherwise("medium")


def to_mask(spans: Column) -> Column:
    """High spans, then medium ones."""
    return F.concat(*[F.filter(spans, lambda s: tier(s["score"], s["standalone_non_pii"]) == "high"), F.filter(spans, lambda s: tier(s["score"], s["standalone_non_pii"]) == "medium")])


def at_least(spans: Column, score: float) -> Column:
    return F.filter(spans, lambda s: s["score"] >= score) if score > 0 else spans
