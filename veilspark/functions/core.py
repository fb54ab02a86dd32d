"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One detection. start and ord lead, so that sorting an array of spans is the stable order of detection.
SPAN = (
    "struct<start:int,ord:int,end:int,entity_type:string,value:string,score:double,layer:string,label_boosted:boolean,proximity_boosted:boolean,"
    "slide6_boosted:boolean,column_name_boosted:boolean,density_boosted:boolean,standalone_non_pii:boolean,linked_to_identity:boolean>"
)
FLAGS = ("label_boosted", "proximity_boosted", "slide6_boosted", "column_name_boosted", "density_boosted", "standalone_non_pii", "linked_to_identity")
MATCH = "struct<start:int,end:int,value:string>"


#: Up to so many pairs are looked at one by one, and up to so many numbers merged in one pass.
FEW, SHORT = 256, 128


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def taken(array: Column, start: Column, n: Column) -> Column:
    """n elements (one at least) of an array; slice() would copy the whole array each time."""
    return F.transform(F.sequence(start, start + n - 1), lambda j: F.get(array, j))


def groups(array: Column, n: int) -> Column:
    """An array in groups of n; the last may be shorter, and no elements give no groups."""
    cut = lambda own: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / n).cast("int")), lambda i: taken(own, i * n, F.least(F.lit(n), F.size(own) - i * n)))
    return let(array, lambda own: F.when(F.size(own) > 0, cut(own)).otherwise(F.array()))


def clamp(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    """A small fixed table as one conditional expression."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def running(values: Column, merge=lambda a, b: a + b, zero: int = 0) -> Column:
    """What merge (associative) gives for each whole number and all before it, such as running sums.

    Each step merges what stands twice as far back as the step before, so n numbers take log2(n) passes and no array grows by copies.
    A few numbers are merged in one pass that copies what it has, which is sooner done.
    """
    steps = lambda own: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(own))).cast("int") - 1))

    def doubled(acc: Column, k: Column) -> Column:
        # One step back is 1, 2, 4, ... and less than the size.
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, merge(F.get(acc, i - back), x)).otherwise(x))

    first = lambda own: F.transform(own, lambda x, i: F.when(i == 0, merge(F.lit(zero), x)).otherwise(x)).cast("array<int>")
    put = lambda acc, n: F.struct(n.alias("last"), F.concat(acc["out"], F.array(n)).alias("out"))
    plain = lambda own: F.aggregate(own, F.struct(F.lit(zero).alias("last"), empty("int").alias("out")), lambda acc, x: put(acc, merge(acc["last"], x).cast("int")))["out"]
    return let(values, lambda own: F.when(F.size(own) <= SHORT, plain(own)).otherwise(F.aggregate(steps(own), first(own), doubled)))


def inside(points: Column, zones: Column) -> Column:
    """Per point whether it lies in a zone (struct of from and to, both included). All ends are sorted once, so no point looks at every zone,
    unless both are few."""
    # At one place zones open before the points and close behind them.
    event = lambda at, turn, place, step: F.struct(at.cast("bigint").alias("at"), F.lit(turn).alias("turn"), place.cast("int").alias("place"), F.lit(step).alias("step"))

    def swept(ends: Column) -> Column:
        def answered(depth: Column) -> Column:
            own = F.filter(F.zip_with(ends, depth, lambda e, d: F.struct(e["place"].alias("place"), (d > 0).alias("hit"), e["turn"].alias("turn"))), lambda x: x["turn"] == 1)
            return F.transform(F.sort_array(own), lambda x: x["hit"])

        return let(running(F.transform(ends, lambda e: e["step"])), answered)

    def judged(points: Column, zones: Column) -> Column:
        marks = F.transform(points, lambda p, i: event(p, 1, i, 0))
        opened, closed = F.transform(zones, lambda z: event(z["from"], 0, F.lit(0), 1)), F.transform(zones, lambda z: event(z["to"], 2, F.lit(0), -1))
        plain = F.transform(points, lambda p: F.exists(zones, lambda z: (z["from"] <= p) & (p <= z["to"])))
        return F.when(F.size(points) * F.size(zones) <= FEW, plain).otherwise(let(F.sort_array(F.concat(marks, opened, closed)), swept))

    # Zones that are not a column yet would be worked out again for each point.
    return let(points, lambda own: let(zones, lambda found: judged(own, found)))


def stretches(text: Column, body, block: int = 4096) -> Column:
    """body(part), where part(start, length) is a part of the text, in code points.

    To find a place in a text means to read it from its start; so it is cut into blocks once, and a part is taken from its blocks.
    """

    def held(blocks: Column) -> Column:
        def part(start: Column, length: Column) -> Column:
            first = F.floor(start / block).cast("int")
            own = F.array_join(F.slice(blocks, first + 1, F.floor((start + length) / block).cast("int") - first + 1), "")
            return F.when(F.octet_length(text) <= block, F.substring(text, start + 1, length)).otherwise(F.substring(own, start - first * block + 1, length))

        return body(part)

    return let(F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / block).cast("int")), lambda i: F.substring(text, i * block + 1, F.lit(block))), held)


#: Put around matches for a moment; texts that hold it are read twice instead.
SIGN = "\x01"


def found_by(text: Column, pattern: str, signed: Column | None = None) -> Column:
    """struct(found, gaps): a pattern's leftmost, non-overlapping matches, and what stands around them (null where there are none).

    Matches and gaps take turns between the signs that one pass puts around the matches. signed: whether the text holds such a sign already.
    """

    def turns(parts: Column) -> Column:
        every = lambda first, n: F.transform(F.sequence(F.lit(0), n), lambda i: F.get(parts, i * 2 + first))
        n = F.floor(F.size(parts) / 2).cast("int")
        none = F.struct(empty("string").alias("found"), F.lit(None).cast("array<string>").alias("gaps"))
        return F.when(F.size(parts) < 3, none).otherwise(F.struct(every(1, n - 1).alias("found"), every(0, n).alias("gaps")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    twice = let(found, lambda own: F.struct(own.alias("found"), F.when(F.size(own) > 0, F.split(text, pattern, -1)).alias("gaps")))
    once = let(F.split(F.regexp_replace(text, pattern, f"{SIGN}$0{SIGN}"), SIGN, -1), turns)
    return F.when(F.contains(text, F.lit(SIGN)) if signed is None else signed, twice).otherwise(F.when(text.isNotNull(), once))


def placed(found: Column, gaps: Column) -> Column:
    """Array of (start, end, value), in code points. Offsets follow from the lengths of matches and gaps, so the work stays in the JVM and in one row."""
    ends = running(F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(g) + F.length(m)))
    return F.zip_with(found, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of a pattern's matches."""
    # Most rows match few patterns.
    return let(found_by(text, pattern), lambda own: F.when(own["gaps"].isNull(), empty(MATCH)).otherwise(placed(own["found"], own["gaps"])))


def span(start: Column, ord: Column, end: Column, entity_type: Column, value: Column, score: Column, layer: Column) -> Column:
    """A span with all flags down."""
    return F.struct(
        start.cast("int").alias("start"), ord.cast("int").alias("ord"), end.cast("int").alias("end"), entity_type.alias("entity_type"), value.alias("value"), score.cast("double").alias("score"), layer.alias("layer"), *[F.lit(False).alias(f) for f in FLAGS]
    )


def rows_of(df: DataFrame, array: str, *keys: str) -> DataFrame:
    """One row per struct of a column of arrays, beside the keys; none for empty and null arrays.

    A plain inline() of a column implies that its array has elements. That test is moved, with the whole expression that makes the array,
    below the dealing out of rows, and texts would be searched twice more, by the few tasks that read the file. The outer form implies nothing.
    """
    out = df.select(*keys, F.posexplode_outer(array).alias("_pos", "_each"))
    return out.where("_pos IS NOT NULL").select(*keys, "_each.*")


def numbered(spans: Column) -> Column:
    """The same spans with ord as their place in the array."""
    return F.transform(spans, lambda s, i: s.withField("ord", i.cast("int")))
