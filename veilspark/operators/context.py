"""Context rules: scores rise with labels, company, identity anchors, dense sentences and column names.

All rules work on the array of spans of one text, in one row, so a text's spans are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.core import clamp, col, inside, let, matches, running
from veilspark.operators.detect import column_type

SENTENCE = r"[^.!?\n]+[.!?\n]?"


def _raised(s: Column, test: Column, score, *flags: str) -> Column:
    """s with score(s) and its flags up where the test holds; the test is worked out once."""

    def lifted(hit: Column) -> Column:
        up = s.withField("score", score(s))
        for flag in flags:
            up = up.withField(flag, F.lit(True))
        return F.when(hit, up).otherwise(s)

    return let(test, lifted)


def label_boost(spans: Column, pairs: Column) -> Column:
    """Once, if a label of the same type ends up to 50 code points before the span."""

    def boosted(found: Column, own: Column) -> Column:
        def typed(kinds: Column) -> Column:
            # Each type has a range of places of its own, so one sweep serves all of them.
            place = lambda kind, at: F.array_position(kinds, kind).cast("bigint") * (1 << 40) + at
            zones = F.transform(found, lambda p: F.struct(place(p["entity_type"], p["label_end"]).alias("from"), (place(p["entity_type"], p["label_end"]) + fixed.LABEL_GAP).alias("to")))
            hits = inside(F.transform(own, lambda s: place(s["entity_type"], s["start"])), zones)
            return F.zip_with(own, hits, lambda s, hit: _raised(s, hit, lambda t: clamp(t["score"] + fixed.LABEL_BOOST), "label_boosted"))

        return F.when((F.size(found) == 0) | (F.size(own) == 0), own).otherwise(let(F.array_distinct(F.transform(found, lambda p: p["entity_type"])), typed))

    return let(pairs, lambda found: let(spans, lambda own: boosted(found, own)))


def proximity_boost(spans: Column) -> Column:
    """By the number of other spans that start within 150 code points: 1 or 2, or more.

    In the order of starts those are next to the span, and three on a side tell all that counts.
    """

    def company(own: Column) -> Column:
        def lifted(s: Column, i: Column) -> Column:
            near = [F.coalesce(F.abs(F.get(own, i + k)["start"] - s["start"]) <= fixed.PROXIMITY_WINDOW, F.lit(False)).cast("int") for k in (-3, -2, -1, 1, 2, 3)]

            def judged(others: Column) -> Column:
                boost = F.when(others <= 2, F.lit(fixed.PROXIMITY_BOOST)).otherwise(F.lit(fixed.PROXIMITY_BOOST * 2))
                return _raised(s, others > 0, lambda t: clamp(t["score"] + boost), "proximity_boosted")

            return let(near[0] + near[1] + near[2] + near[3] + near[4] + near[5], judged)

        return F.transform(own, lifted)

    return F.sort_array(let(F.sort_array(spans), company))


def anchor_rule(spans: Column) -> Column:
    """Identity anchors (sure names and mail addresses) lift uncertain spans around them; weak or contextual ones elsewhere stand alone."""

    def judged(s: Column, near: Column) -> Column:
        free = ~s["entity_type"].isin(*fixed.ANCHOR_TYPES)
        contextual = s["entity_type"].isin(*fixed.CONTEXTUAL_TYPES)
        weak, unsure = s["score"] < fixed.UNCERTAIN, (s["score"] >= fixed.UNCERTAIN) & (s["score"] < fixed.HIGH)
        lifted = lambda t: F.when(contextual, clamp(F.greatest(t["score"], F.lit(fixed.CONTEXTUAL_SCORE)))).when(unsure, clamp(t["score"] + fixed.ANCHOR_BOOST)).otherwise(F.lit(fixed.ANCHOR_LIFT))
        alone = s.withField("standalone_non_pii", F.lit(True))
        return F.when(free & ~near & (contextual | weak), alone).otherwise(_raised(s, free & near & (contextual | weak | unsure), lifted, "slide6_boosted", "linked_to_identity"))

    def ruled(own: Column) -> Column:
        anchors = F.filter(own, lambda s: s["entity_type"].isin(*fixed.ANCHOR_TYPES) & (s["score"] >= fixed.ANCHOR_SCORE))
        zones = F.transform(anchors, lambda a: F.struct((a["start"] - fixed.ANCHOR_ZONE).alias("from"), (a["end"] + fixed.ANCHOR_ZONE).alias("to")))
        return F.zip_with(own, inside(F.transform(own, lambda s: s["start"]), zones), judged)

    return let(spans, ruled)


def sentences(text: Column | str) -> Column:
    return matches(col(text), SENTENCE)


def density_boost(text: Column | str, spans: Column) -> Column:
    """All spans of a sentence that has three or more. Sentences and spans are sorted together, so each span finds its own in passing."""

    def event(at: Column, turn: int, place: Column, step: int) -> Column:
        return F.struct(at.cast("int").alias("at"), F.lit(turn).alias("turn"), place.cast("int").alias("place"), F.lit(step).alias("step"))

    def numbered(events: Column) -> Column:
        """Of the spans' events (number of the sentence or null, place): four times the sentences so far, and one while one is open."""
        both = F.zip_with(events, running(F.transform(events, lambda e: e["step"])), lambda e, n: F.struct(F.when(n % 4 > 0, n).alias("n"), e["place"].alias("place"), e["turn"].alias("turn")))
        return F.sort_array(F.filter(both, lambda x: x["turn"] == 2))

    def dense(ordered: Column) -> Column:
        """Per span, by place, whether two others are in its sentence: they are its neighbours here."""
        same = lambda i, x, *steps: F.coalesce(F.get(ordered, i + steps[0])["n"] == x["n"], F.lit(False)) & F.coalesce(F.get(ordered, i + steps[1])["n"] == x["n"], F.lit(False))
        hits = F.transform(ordered, lambda x, i: F.struct(x["place"].alias("place"), (same(i, x, -2, -1) | same(i, x, -1, 1) | same(i, x, 1, 2)).alias("hit")))
        return F.transform(F.sort_array(hits), lambda x: x["hit"])

    def boosted(own: Column) -> Column:
        # A sentence ends before what starts at its end.
        ends = lambda found: F.concat(F.transform(found, lambda x: event(x["end"], 0, F.lit(0), -1)), F.transform(found, lambda x: event(x["start"], 1, F.lit(0), 5)))
        events = F.sort_array(F.concat(let(sentences(text), ends), F.transform(own, lambda s, i: event(s["start"], 2, i, 0))))
        return F.zip_with(own, let(let(events, numbered), dense), lambda s, hit: _raised(s, hit, lambda t: clamp(t["score"] + fixed.DENSITY_BOOST), "density_boosted"))

    # Fewer than three spans are never dense.
    return let(spans, lambda own: F.when(F.size(own) < fixed.DENSITY_HITS, own).otherwise(boosted(own)))


def column_boost(spans: Column, column_name: str | None) -> Column:
    """Spans of the type that the column's name tells score 0.95 at least."""
    kind = column_type(column_name) if column_name else None
    if kind is None:
        return spans
    return F.transform(spans, lambda s: _raised(s, s["entity_type"] == kind, lambda t: clamp(F.greatest(t["score"], F.lit(fixed.COLUMN_SCORE))), "column_name_boosted"))
