"""Masking of texts: by position, or by value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.core import col, let, running, stretches
from veilspark.functions.mask import REDACTED, partial_mask, token
from veilspark.functions.replace import replaced

MODES = ("redact", "mask", "tokenize")


def _counted(array: Column) -> Column:
    """How many of the same entity_type stand up to each element, itself included: sorted by type, an element's distance from its type's first."""

    def numbered(ordered: Column) -> Column:
        heads = F.transform(ordered, lambda x, i: F.when((i == 0) | (F.get(ordered, i - 1)["kind"] != x["kind"]), i).otherwise(0))
        own = let(running(heads, F.greatest), lambda first: F.transform(ordered, lambda x, i: F.struct(x["place"].alias("place"), (i - F.get(first, i) + 1).alias("n"))))
        return F.transform(F.sort_array(own), lambda x: x["n"])

    return let(F.sort_array(F.transform(array, lambda x, i: F.struct(x["entity_type"].alias("kind"), i.alias("place")))), numbered)


def _replacement(value: Column, entity_type: Column, n: Column, mode: str) -> Column:
    if mode == "mask":
        return partial_mask(value, entity_type)
    return token(entity_type, n) if mode == "tokenize" else F.lit(REDACTED)


def _from_last(spans: Column) -> Column:
    """What masks need of spans, from the last to the first."""
    return F.sort_array(F.transform(spans, lambda s, i: F.struct((-s["start"]).alias("k"), i.alias("i"), s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"))))


def _pieces(own: Column, part, mode: str) -> Column:
    """Start, end, value and replacement of each span."""

    def piece(x: Column, n: Column) -> Column:
        def of(value: Column) -> Column:
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), value.alias("value"), _replacement(value, x["entity_type"], n, mode).alias("to"))

        return let(part(x["start"], x["end"] - x["start"]), of) if mode in MODES[1:] else of(F.lit(""))

    return F.zip_with(own, _counted(own), piece) if mode == "tokenize" else F.transform(own, lambda x: piece(x, F.lit(0)))


def _tokens(pieces: Column) -> Column:
    return F.map_from_entries(F.transform(pieces, lambda p: F.struct(p["to"], p["value"])))


def mask_positions(text: Column | str, spans: Column, mode: str = "redact") -> Column:
    """struct(masked_text, token_map): spans are replaced from the last to the first, and tokens number from there. Unknown modes redact."""
    t = col(text)

    def masked(part, own: Column) -> Column:
        def put(pieces: Column) -> Column:
            def joined(forward: Column) -> Column:
                last = lambda i: F.coalesce(F.get(forward, i - 1)["end"], F.lit(0))
                parts = F.transform(forward, lambda p, i: F.concat(part(last(i), p["start"] - last(i)), p["to"]))
                rest = part(last(F.size(forward)), F.length(t) - last(F.size(forward)))
                # Spans that overlap are replaced one after another, from the last.
                across = F.aggregate(pieces, t, lambda acc, p: F.concat(F.left(acc, p["start"]), p["to"], F.substring(acc, p["end"] + 1, F.length(acc))))
                meets = F.exists(F.transform(forward, lambda p, i: (last(i) > p["start"]) | (p["end"] < p["start"])), lambda x: x)
                return F.when(F.size(forward) == 0, t).when(meets, across).otherwise(F.concat(F.array_join(parts, ""), rest))

            tokens = _tokens(pieces) if mode == "tokenize" else F.create_map().cast("map<string,string>")
            return F.struct(let(F.reverse(pieces), joined).alias("masked_text"), tokens.alias("token_map"))

        return let(_pieces(own, part, mode), put)

    # Spans may be the result of a search: they are worked out once, before all that is made of them.
    return let(_from_last(spans), lambda own: stretches(t, lambda part: masked(part, own)))


def token_map(text: Column | str, spans: Column) -> Column:
    """The token_map of `mask_positions`, for those who need no masked text."""
    return let(_from_last(spans), lambda own: stretches(col(text), lambda part: _tokens(_pieces(own, part, "tokenize"))))


ENTRY = "struct<value:string,to:string>"


def value_map(spans: Column, mode: str = "redact") -> Column:
    """Array of (value, to): each distinct value once, by its first detection; empty values are skipped.

    Tokens number each type's values by first appearance in the text, so a rerun gives the same ones.
    """
    first = F.filter(F.transform(spans, lambda s: F.struct(s["value"].alias("value"), s["entity_type"].alias("entity_type"))), lambda s: s["value"] != "")

    def distinct(found: Column) -> Column:
        # The first of each value once they are sorted by value and place.
        ordered = F.sort_array(F.transform(found, lambda s, i: F.struct(s["value"].alias("value"), i.alias("place"), s["entity_type"].alias("entity_type"))))
        once = lambda own: F.filter(own, lambda x, i: (i == 0) | (F.get(own, i - 1)["value"] != x["value"]))
        back = F.sort_array(F.transform(let(ordered, once), lambda x: F.struct(x["place"].alias("place"), x["value"].alias("value"), x["entity_type"].alias("entity_type"))))
        return F.transform(back, lambda x: F.struct(x["value"].alias("value"), x["entity_type"].alias("entity_type")))

    def entries(once: Column) -> Column:
        numbers = _counted(once) if mode == "tokenize" else F.transform(once, lambda x: F.lit(0))
        return F.zip_with(once, numbers, lambda s, n: F.struct(s["value"].alias("value"), _replacement(s["value"], s["entity_type"], n, mode).alias("to")))

    return let(let(first, distinct), entries)


def distinct_values(spans: DataFrame, *keys: str) -> DataFrame:
    """Each value that is not empty once, over all spans with the same keys, by rows: copies are dropped before they are shuffled."""
    return spans.where(F.col("value") != "").select(*keys, "value").distinct()


def longest_first(entries: Column) -> Column:
    """Entries by falling length of the value; equal lengths keep their order."""
    return F.transform(F.sort_array(F.transform(entries, lambda e, i: F.struct((-F.length(e["value"])).alias("k"), i.alias("i"), e.alias("e")))), lambda x: x["e"])


def replace_values(text: Column | str, entries: Column, longest: bool = True) -> Column:
    """Literal replacements one after another; a later value may hit what an earlier one has put there."""
    return F.aggregate(longest_first(entries) if longest else entries, col(text), lambda acc, e: F.replace(acc, e["value"], e["to"]))


def replace_once(text: Column | str, entries: Column, ordered: bool = False) -> Column:
    """All values in one pass from the left, the longest first where several fit; what has been put there is not looked at again.

    ordered: the entries are `longest_first` already, so that many texts with the same entries do not each sort them.
    """
    t = col(text)

    def walked(found: Column) -> Column:
        """Jumps from one match to the next: the first place of each value from here on, the leftmost and then the longest of them."""

        def step(acc: Column, _: Column) -> Column:
            places = F.filter(F.transform(found, lambda e, i: F.struct(F.call_function("locate", e["value"], t, acc["at"]).alias("p"), i.alias("i"), e.alias("e"))), lambda x: x["p"] > 0)

            def put(hit: Column) -> Column:
                end = hit["p"] + F.length(hit["e"]["value"])
                moved = F.struct(end.alias("at"), F.concat(acc["out"], F.substring(t, acc["at"], hit["p"] - acc["at"]), hit["e"]["to"]).alias("out"))
                return F.when(hit.isNull(), acc).otherwise(moved)

            return let(F.array_min(places), put)

        most = F.aggregate(found, F.lit(0), lambda n, e: n + ((F.length(t) - F.length(F.replace(t, e["value"], F.lit("")))) / F.length(e["value"])).cast("int"))
        start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
        rest = lambda acc: F.concat(acc["out"], F.substring(t, acc["at"], F.length(t)))
        return F.when(F.size(found) == 0, t).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), most)), start, step, rest))

    return let(F.filter(entries if ordered else longest_first(entries), lambda e: F.contains(t, e["value"])), walked)


#: Up to so many values are replaced by built-ins, a pass over the text for each; more of them by one pass for all.
FEW = 32


def replace_many(texts: Column, entries: Column, way: str = "longest") -> Column:
    """An array of texts, with the same entries replaced in each: `longest` first or `as given`, one after another, or all at `once`.

    The work grows with the texts and with the entries, not with their product. A null array of texts stays null, and a null text in it too;
    no entries leave all as it is. Not for use within a lambda, as many entries are left to an Arrow UDF.
    """
    few = F.size(entries) <= FEW
    built_in = (lambda t: replace_once(t, entries)) if way == "once" else lambda t: replace_values(t, entries, longest=way == "longest")
    return F.when(few, F.transform(texts, built_in)).otherwise(replaced(F.when(~few, texts), F.when(~few, entries), way))


def replace_all(text: Column | str, entries: Column, way: str = "longest") -> Column:
    """The same for one text."""
    return replace_many(F.array(col(text)), entries, way)[0]


def detokenize(text: Column | str, token_map: Column) -> Column:
    """The values that tokens stand for, put back."""
    return F.aggregate(F.map_entries(token_map), col(text), lambda acc, e: F.replace(acc, e["key"], e["value"]))
