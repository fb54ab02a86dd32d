"""Chunks that carry marked context of their neighbours, and one text or one summary made of them again.

Chunks of a text are an array in its row, so splitting, marking, stripping and joining shuffle nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.core import col, empty, let, running, strip
from veilspark.operators.chunking import statement_context

_BLANK = r"(?U)^\s*$"


def paragraphs(text: Column | str) -> Column:
    """Stretches between empty lines that hold more than white space."""
    return F.filter(F.split(col(text), "\n\n", -1), lambda p: ~p.rlike(_BLANK))


def paragraph_groups(text: Column | str, n: int = fixed.CHUNKS_LARGE["txt"]) -> Column:
    """Paragraphs in groups of up to n code points, not counting what parts them; a longer one is a group of its own. No paragraphs, no groups."""

    def step(acc: Column, p: Column) -> Column:
        full = (acc["size"] + F.length(p) > n) & acc["open"].isNotNull()
        done = F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full | acc["open"].isNull(), p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p)).alias("open"), F.when(full, F.length(p)).otherwise(acc["size"] + F.length(p)).alias("size"))

    start = F.struct(empty("string").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("size"))
    return F.aggregate(paragraphs(text), start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def marked(groups: Column, overlap: int = fixed.TEXT_OVERLAP) -> Column:
    """Each group with up to `overlap` code points of its neighbours, marked as such."""

    def of(own: Column) -> Column:
        before = lambda i: F.when(i > 0, F.concat(F.right(F.get(own, i - 1), F.lit(overlap)), F.lit(f"\n{fixed.OVERLAP_BEFORE}\n"))).otherwise("")
        after = lambda i: F.when(i < F.size(own) - 1, F.concat(F.lit(f"\n{fixed.OVERLAP_AFTER}\n"), F.left(F.get(own, i + 1), F.lit(overlap)))).otherwise("")
        return F.transform(own, lambda g, i: F.concat(before(i), g, after(i)))

    return let(groups, of) if overlap > 0 else groups


def unmarked(content: Column) -> Column:
    """What stands between the marks, without the line ends next to them; the first mark of either kind counts."""
    head = F.instr(content, fixed.OVERLAP_BEFORE)
    tail = F.when(head > 0, F.regexp_replace(F.substr(content, head + len(fixed.OVERLAP_BEFORE)), r"\A\n+", "")).otherwise(content)
    return let(tail, lambda x: F.when(F.contains(x, F.lit(fixed.OVERLAP_AFTER)), F.regexp_replace(F.substring_index(x, fixed.OVERLAP_AFTER, 1), r"\n+\z", "")).otherwise(x))


def merged(contents: Column) -> Column:
    """One text of marked chunks in order."""
    return F.concat(F.array_join(F.transform(contents, unmarked), "\n\n"), F.lit("\n"))


def same_paragraphs(original: Column | str, again: Column | str) -> Column:
    """struct(paragraphs, merged_paragraphs, intact)."""
    return let(F.struct(F.size(paragraphs(original)).alias("a"), F.size(paragraphs(again)).alias("b")), lambda x: F.struct(x["a"].alias("paragraphs"), x["b"].alias("merged_paragraphs"), (x["a"] == x["b"]).alias("intact")))


def marked_statements(statements: Column, n: int, overlap: int = fixed.STATEMENT_OVERLAP) -> Column:
    """Groups of n statements as scripts, the statements around them in comments' brackets."""
    block = lambda kind, own: F.when(F.size(own) > 0, F.concat(F.lit(f"-- {kind}_START\n"), F.array_join(own, "\n"), F.lit(f"\n-- {kind}_END\n"))).otherwise("")
    return F.transform(statement_context(statements, n, overlap), lambda g: F.concat(block("CONTEXT_OVERLAP", g["before"]), F.array_join(g["statements"], "\n"), F.lit("\n"), block("CONTEXT_OVERLAP_AFTER", g["after"])))


def script_header(text: Column | str) -> Column:
    """The comment, SET and USE lines that a script begins with, without white space behind them."""
    return F.regexp_replace(F.regexp_extract(col(text), fixed.SCRIPT_HEADER, 0), r"(?U)\s+\z", "")


def merged_script(contents: Column, original: Column | str) -> Column:
    """One script of marked ones in order; the original's header goes before it where it is not there already."""
    clean = F.transform(contents, lambda c: strip(F.regexp_replace(F.regexp_replace(c, fixed.SCRIPT_BEFORE, ""), fixed.SCRIPT_AFTER, "")))

    def headed(x: Column) -> Column:
        whole = F.when((x["head"] != "") & ~x["body"].startswith(x["head"]), F.concat(x["head"], F.lit("\n"), x["body"])).otherwise(x["body"])
        return F.concat(whole, F.lit("\n"))

    return let(F.struct(F.array_join(clean, "\n\n").alias("body"), script_header(original).alias("head")), headed)


def shared_end(a: Column, b: Column, most: int = fixed.TEXT_OVERLAP) -> Column:
    """How many code points, `most` at most, the end of a and the start of b have in common: the most that fit."""

    def longest(x: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(0), F.least(F.length(x["a"]), F.length(x["b"]))), lambda k: F.right(x["a"], k) == F.left(x["b"], k))
        return F.coalesce(F.array_max(fits), F.lit(0))

    return let(F.struct(F.right(a, F.lit(most)).alias("a"), F.left(b, F.lit(most)).alias("b")), longest)


def stitched(parts: Column, most: int = fixed.TEXT_OVERLAP) -> Column:
    """One text of parts that repeat the end of the part before: what both share is taken once. The work is `most` squared for each border."""
    cut = lambda own: F.array_join(F.transform(own, lambda p, i: F.when(i == 0, p).otherwise(F.substr(p, shared_end(F.get(own, i - 1), p, most) + 1))), "")
    return let(parts, cut)


def chunk_spans(chunks: Column, spans_of) -> Column:
    """Union of the spans of all chunks (idx, before, text, after), each searched with its context: struct(idx, own, span).

    Spans count from the start of the whole text. own tells those that start in the chunk itself; what starts in mere context is found
    again by the neighbour, so own spans count once and all spans as often as they are found.
    """

    def found(all_: Column) -> Column:
        def one(c: Column, end: Column) -> Column:
            lead, size = F.length(c["before"]), F.length(c["text"])
            place = lambda s: s.withField("start", (s["start"] - lead + end - size).cast("int")).withField("end", (s["end"] - lead + end - size).cast("int"))
            own = lambda s: (s["start"] >= lead) & (s["start"] < lead + size)
            return F.transform(let(F.concat(c["before"], c["text"], c["after"]), lambda t: spans_of(t)), lambda s: F.struct(c["idx"].alias("idx"), own(s).alias("own"), place(s).alias("span")))

        return let(running(F.transform(all_, lambda c: F.length(c["text"]))), lambda ends: F.flatten(F.zip_with(all_, ends, one)))

    return let(chunks, found)


def counted(spans: Column, overlap: bool) -> Column:
    """Spans of `chunk_spans` that a summary counts: all as often as they are found, or each once."""
    return F.transform(spans if overlap else F.filter(spans, lambda x: x["own"]), lambda x: x["span"])
