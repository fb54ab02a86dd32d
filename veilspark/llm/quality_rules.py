"""Quality rules: text statistics and a learned decision list, all in native expressions.

The statistics come from array functions inside one row, so nothing is shuffled. Sequential covering learns the list from a bounded,
documented sample of labelled rows (max_rows): a rule against bad texts grows by the threshold of most information gain, is pruned
on rows it has not seen, and is kept if it is precise there; what it covers is set aside, and the next rule grows on the rest. The
list is emitted as one ordered conditional expression.

Defined results: a null text has no words and fails the base rule; repeated rows are judged alike; without labelled rows, or with
one label only, the list is empty and the base rule decides; other columns are ignored by the statistics and kept, but for those named
as a result (n_words and so on), which the results replace.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.core import let
from veilspark.llm.common import bounded_sample, unclashing

WORDS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _pairs(hashes: Column, step: int) -> Column:
    """Hashes of each element and the one `step` after it, where there is one."""
    return F.slice(F.zip_with(hashes, F.slice(hashes, F.lit(step + 1), F.size(hashes)), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.size(hashes) - step, F.lit(0)))


def _repeated(windows: Column, width: int) -> Column:
    """Words that lie in windows found twice or more."""

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda x, y: x + y)

    def places(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(let(ordered, places), covered))


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct_words", "base_failed", "rule", "kept")


def with_statistics(docs: DataFrame, text: str = "text", width: int = 8) -> DataFrame:
    """docs with the statistics as columns; see STATISTICS."""
    plain, names, restored = unclashing(docs)
    t = F.coalesce(F.col(names[text]).cast("string"), F.lit(""))
    split = plain.withColumn("_words", F.filter(F.split(t, WORDS), lambda w: w != "")).withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    hashed = split.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    windows, step = hashed, 1
    while 2 * step <= width:
        windows, step = windows.withColumn("_h", _pairs(F.col("_h"), step)), 2 * step
    if step < width:  # two windows of a power of two that overlap
        windows = windows.withColumn("_h", _pairs(F.col("_h"), width - step))
    out = windows.select(
        *[c for c, old in zip(restored, docs.columns, strict=True) if old not in RESULTS],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") <= width, F.lit(0)).otherwise(_repeated(F.col("_h"), width)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length(t) - F.length(F.translate(t, UPPER, ""))).cast("long").alias("n_upper"),
        (F.length(t) - F.length(F.translate(t, "!?", ""))).cast("long").alias("n_marks"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


#: What rules may look at: names and SQL over the statistics.
STATISTICS: dict[str, str] = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "distinct_words": "n_distinct_words / greatest(n_words, 1)",
}

Condition = tuple[str, str, float]
Rule = tuple[Condition, ...]


def holds(rule: Rule, row: dict[str, float]) -> bool:
    return all(row[name] >= x if sign == ">=" else row[name] <= x for name, sign, x in rule)


def _grow(rows: list[dict[str, float]], bad: list[bool], longest: int, cuts: int) -> Rule:
    """Adds the condition of most gain in information until no good row is covered."""
    at, rule = list(range(len(rows))), ()
    while len(rule) < longest:
        p = sum(bad[i] for i in at)
        if not p or p == len(at):
            break
        before, best = log2(p / len(at)), (1e-9, None)
        for name in STATISTICS:
            ordered = sorted(at, key=lambda i: rows[i][name])
            up_to, seen = [], 0
            for i in ordered:
                seen += bad[i]
                up_to.append(seen)
            # Cuts lie between values around which the label changes, or at quantiles if those are too many.
            edges = [k for k in range(1, len(ordered)) if rows[ordered[k]][name] > rows[ordered[k - 1]][name]]
            edges = edges if len(edges) <= cuts else [edges[j * len(edges) // cuts] for j in range(cuts)]
            for k in edges:
                x = (rows[ordered[k]][name] + rows[ordered[k - 1]][name]) / 2
                for sign, q, n in (("<=", up_to[k - 1], k), (">=", p - up_to[k - 1], len(ordered) - k)):
                    if q and (gain := q * (log2(q / n) - before)) > best[0]:
                        best = (gain, (name, sign, x))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        at = [i for i in at if holds((best[1],), rows[i])]
    return rule


def tightest(rule: Rule) -> Rule:
    """The rule without conditions that another of its conditions implies."""
    implied = lambda c, d: c[:2] == d[:2] and c != d and (d[2] > c[2] if c[1] == ">=" else d[2] < c[2])
    return tuple(c for i, c in enumerate(rule) if c not in rule[:i] and not any(implied(c, d) for d in rule))


def _worth(rule: Rule, rows: list[dict[str, float]], bad: list[bool]) -> tuple[float, int]:
    """Precision with one doubt on either side, and bad rows covered."""
    hit = [b for r, b in zip(rows, bad, strict=True) if holds(rule, r)]
    return (sum(hit) + 1) / (len(hit) + 2), sum(hit)


def cover(rows: list[dict[str, float]], bad: list[bool], precise: float = 0.9, most_rules: int = 12, longest: int = 3, cuts: int = 64) -> list[Rule]:
    """Sequential covering: an ordered list of rules that tell bad rows."""
    rules: list[Rule] = []
    for turn in range(most_rules):
        grown, pruned = ([i for i in range(len(rows)) if ((i + turn) % 3 > 0) == part] for part in (True, False))
        rule = _grow([rows[i] for i in grown], [bad[i] for i in grown], longest, cuts)
        unseen = [rows[i] for i in pruned], [bad[i] for i in pruned]
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, *unseen)[0], default=())
        if not rule or _worth(rule, *unseen)[0] < precise or _worth(rule, rows, bad)[0] < precise:
            break
        rules.append(tightest(rule))
        left = [i for i in range(len(rows)) if not holds(rule, rows[i])]
        rows, bad = [rows[i] for i in left], [bad[i] for i in left]
        if not any(bad):
            break
    return rules


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_rows: int = 3000, **options) -> list[Rule]:
    """Rules from about max_rows labelled documents at most."""
    own = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("double").alias("_label"))
    # Bounded by max_rows, so it may be broadcast.
    own = F.broadcast(bounded_sample(own, "_id", max_rows))
    sample = docs.select(F.col(doc_id).alias("_key"), F.col(text).alias("_text")).join(own, F.col("_key") == F.col("_id"))
    rows = with_statistics(sample, "_text").select("_id", "_label", *[F.expr(sql).cast("double").alias(name) for name, sql in STATISTICS.items()]).orderBy(F.xxhash64("_id"), "_id", "_label").collect()
    return cover([r.asDict() for r in rows], [r["_label"] < 0.5 for r in rows], **options)


def expression(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for name, sign, x in rule:
            value = F.expr(STATISTICS[name]).cast("double")
            test &= value >= x if sign == ">=" else value <= x
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """docs with statistics, base_failed, rule (the one that rejects it, null if none) and kept."""
    out = with_statistics(docs, text).withColumn("rule", expression(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
