"""JSON texts of any shape: leaves of any depth with their paths, masked where they stand, and written again with or without indents.

A JSON text is a row of tokens, and what a string literal is can be told without knowing the shape: quotes stand nowhere else. So tokens
are cut by one pattern, leaves are the literals that no colon follows, and the text is put together again from the same tokens. Keys,
their order, and numbers as they are spelled stay; all of it is array work in the JVM, in time that grows with the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.core import col, empty, groups, let, running

TOKEN = r'"(?:[^"\\]++|\\.)*+"|[\[\]{}:,]|[^\s\[\]{}:,"]++'
BLANK = r"(?U)^\s*$"
LEAF = "struct<path:string,leaf_idx:int,value:string>"
#: Paths are gathered so many at a time before they are put together.
GROUP = 256


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _depth(tokens: Column) -> Column:
    """How many brackets are open behind each token."""
    return running(F.transform(tokens, lambda t: F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)))


def is_json(text: Column | str) -> Column:
    """Whether a text is one JSON value and nothing else; null is not."""
    t = col(text)
    closed = lambda own: let(_depth(own), lambda d: (F.size(own) > 0) & (F.get(d, F.size(d) - 1) == 0) & ~F.exists(F.transform(d, lambda n, i: (n <= 0) & (i < F.size(d) - 1)), lambda x: x))
    return F.coalesce(F.try_parse_json(t).isNotNull() & let(_tokens(t), closed), F.lit(False))


def _is_leaf(tokens: Column, t: Column, i: Column) -> Column:
    return t.startswith('"') & ~F.get(tokens, i + 1).eqNullSafe(F.lit(":"))


def _decoded(literal: Column) -> Column:
    return F.when(F.contains(literal, F.lit("\\")), F.get_json_object(literal, "$")).otherwise(F.substring(literal, F.lit(2), F.length(literal) - 2))


def _literal(value: Column) -> Column:
    """A text as JSON: signs beyond ASCII stay as they are."""
    rich = F.to_json(F.struct(value.alias("a")))
    return F.when(value.rlike(r'["\\\x00-\x1f]'), F.substring(rich, F.lit(6), F.length(rich) - 6)).otherwise(F.concat(F.lit('"'), value, F.lit('"')))


def _joined(tokens: Column, indent: int | None) -> Column:
    """Tokens as one text: on one line, or with each element on a line of its own; empty lists and objects stay together. Signs that need no escape have none."""
    plain = lambda t: F.when(F.contains(t, F.lit("\\")), _literal(_decoded(t))).otherwise(t)
    if indent is None:
        return F.array_join(F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(plain(t))), "")

    def spaced(own: Column) -> Column:
        line = lambda n: F.concat(F.lit("\n"), F.repeat(F.lit(" "), n * indent))

        def piece(t: Column, i: Column, depth: Column) -> Column:
            after, before = F.get(own, i + 1), F.get(own, i - 1)
            opens = t.isin("{", "[") & ~after.isin("}", "]")
            closes = t.isin("}", "]") & ~before.isin("{", "[")
            return F.when(opens | (t == ","), F.concat(t, line(depth))).when(closes, F.concat(line(depth), t)).when(t == ":", ": ").otherwise(plain(t))

        return let(_depth(own), lambda d: F.array_join(F.transform(own, lambda t, i: piece(t, i, F.get(d, i))), ""))

    return let(tokens, spaced)


def rewritten(text: Column | str, values: Callable[[Column], Column] | Column, indent: int | None = None) -> Column:
    """The text with its string leaves replaced: values(leaves) gives as many texts as it gets, or values has them. Null where the text is not JSON."""
    t = col(text)
    change = values if callable(values) and not isinstance(values, Column) else None

    def built(x: Column) -> Column:
        own = x["own"]

        def put(flags: Column) -> Column:
            old = lambda: F.transform(F.filter(F.zip_with(own, flags, lambda y, f: F.when(f, y)), lambda y: y.isNotNull()), _decoded)
            place = running(F.transform(flags, lambda f: f.cast("int")))
            new = lambda made, at: F.transform(own, lambda y, i: F.when(F.get(flags, i), _literal(F.get(made, F.get(at, i) - 1))).otherwise(y))
            return let(F.struct((change(old()) if change else x["given"]).alias("made"), place.alias("at")), lambda y: _joined(new(y["made"], y["at"]), indent))

        return let(F.transform(own, lambda y, i: _is_leaf(own, y, i)), put)

    # What is given is named twice, so that Catalyst keeps it as a column of its own: a Python function could not stand within a lambda.
    given = F.lit(None).cast("array<string>") if change else values
    return F.when(is_json(t) & (F.lit(True) if change else given.isNotNull()), let(F.struct(_tokens(t).alias("own"), given.alias("given")), built))


def leaves(text: Column | str, blank: bool = False) -> Column:
    """Array of (path, leaf_idx, value) of the string leaves in the order of the text; blank ones only if asked for.

    A path begins with $; .key follows for a member and [n] for an element. Null where the text is not JSON.
    """
    t = col(text)

    def walked(own: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            stack, tok = acc["stack"], x["t"]
            top = F.get(stack, F.size(stack) - 1)
            below = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
            frame = lambda key, n: F.array(F.struct(key.alias("key"), n.cast("int").alias("n")))
            moved = (
                F.when(tok == "{", F.concat(stack, frame(F.lit(""), F.lit(-1)))).when(tok == "[", F.concat(stack, frame(F.lit(""), F.lit(0)))).when(tok.isin("}", "]"), below)
                .when((tok == ",") & (top["n"] >= 0), F.concat(below, frame(F.lit(""), top["n"] + 1))).when(x["key"], F.concat(below, frame(_decoded(tok), F.lit(-1)))).otherwise(stack)
            )
            path = F.concat(F.lit("$"), F.array_join(F.transform(stack, lambda s: F.when(s["n"] >= 0, F.concat(F.lit("["), s["n"].cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), s["key"]))), ""))
            found = F.struct(path.alias("path"), x["n"].alias("leaf_idx"), _decoded(tok).alias("value"))
            return F.struct(moved.alias("stack"), F.when(x["leaf"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

        def gather(acc: Column, group: Column) -> Column:
            one = F.aggregate(group, F.struct(acc["stack"].alias("stack"), empty(LEAF).alias("out")), step)
            return let(one, lambda y: F.struct(y["stack"].alias("stack"), F.concat(acc["out"], F.array(y["out"])).alias("out")))

        flags = F.transform(own, lambda x, i: F.struct(x.alias("t"), _is_leaf(own, x, i).alias("leaf"), (x.startswith('"') & F.get(own, i + 1).eqNullSafe(F.lit(":"))).alias("key")))

        def grouped(marked: Column) -> Column:
            with_n = let(running(F.transform(marked, lambda x: x["leaf"].cast("int"))), lambda n: F.zip_with(marked, n, lambda x, k: F.struct(x["t"].alias("t"), x["leaf"].alias("leaf"), x["key"].alias("key"), (k - 1).alias("n"))))
            start = F.struct(empty("struct<key:string,n:int>").alias("stack"), empty(f"array<{LEAF}>").alias("out"))
            return F.flatten(F.aggregate(groups(with_n, GROUP), start, gather)["out"])

        return let(flags, grouped)

    found = F.when(is_json(t), let(_tokens(t), walked))
    return found if blank else F.filter(found, lambda x: ~x["value"].rlike(BLANK))


def written(text: Column | str, indent: int | None = None) -> Column:
    """The same value written with or without indents; null where the text is not JSON."""
    t = col(text)
    return F.when(is_json(t), _joined(_tokens(t), indent))
