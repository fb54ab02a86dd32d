"""Many values replaced in one pass: against one replacement after another, and in linear time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilspark.functions import replace
from veilspark.operators import masking, structured, tabular
from veilspark.plans import engines

R = random.Random(5)


def distinct(pairs):
    out = {}
    for value, to in pairs:
        if value:
            out.setdefault(value, to)
    return out


def in_turn(text, pairs, longest=True):
    to = distinct(pairs)
    for v in sorted(to, key=len, reverse=True) if longest else to:
        text = text.replace(v, to[v])
    return text


def once(text, pairs):
    to = distinct(pairs)
    return re.sub("|".join(map(re.escape, sorted(to, key=len, reverse=True))), lambda m: to[m[0]], text) if to else text


@pytest.mark.parametrize("short", [0, 3, 400])
def test_replacer_equals_replacements_in_turn(monkeypatch, short):
    monkeypatch.setattr(replace, "SHORT", short)
    changed = 0
    for _ in range(8000):
        signs = R.choice(["ab", "ab ", "a 1-", "abc [],", "12 -.", "12 "])
        word = lambda most, least=0: "".join(R.choice(signs) for _ in range(R.randint(least, most)))
        plain = R.random() < 0.5
        pairs = [(word(4), "[1R2]" if plain else R.choice([word(4), word(3, 1), "[R]", "ab", "", " "])) for _ in range(R.randint(0, 6))]
        text, longest = word(30), R.random() < 0.7
        assert replace.Replacer(pairs, longest).in_turn(text) == in_turn(text, pairs, longest)
        assert replace.Replacer(pairs).once(text) == once(text, pairs)
        changed += text != in_turn(text, pairs, longest)
    assert changed > 1000


@pytest.mark.parametrize("way", ["longest", "as given", "once"])
def test_few_and_many_values_are_replaced_alike(spark, monkeypatch, way):
    """The built-ins and the pass for many values give the same, on either side of the border between them."""
    rows = []
    for i in range(120):
        pairs = [("".join(R.choice("ab1 [") for _ in range(R.randint(1, 4))), R.choice(["[x]", "a", "b1", "<<A_1>>"])) for _ in range(R.randint(0, 60))]
        rows.append((i, ["".join(R.choice("ab1 []") for _ in range(R.randint(0, 40))), "", None], list(distinct(pairs).items())))
    rows += [(900, None, [("a", "b")]), (901, ["a"], []), (902, [], [("a", "b")] * 40)]
    df = spark.createDataFrame(rows, "id int, texts array<string>, entries array<struct<value:string,to:string>>")
    got = {r.id: r.out for r in df.select("id", masking.replace_many(F.col("texts"), F.col("entries"), way).alias("out")).collect()}
    for i, texts, pairs in rows:
        want = None if texts is None else [None if t is None else once(t, pairs) if way == "once" else in_turn(t, pairs, way == "longest") for t in texts]
        assert got[i] == want


def mails(n):
    return " ".join(f"user{i}@mail{i % 9}.example.com" for i in range(n))


def seconds(run):
    best = []
    for _ in range(2):
        began = time.time()
        run()
        best.append(time.time() - began)
    return min(best)


def test_gated_takes_linear_time_in_values(spark):
    def of(n):
        frame = spark.createDataFrame([(mails(n),)], "text string")
        row = engines.gated(frame).select("masked_text", F.size("spans").alias("n")).first()
        assert row.masked_text == " ".join(["[REDACTED]"] * n) and row.n >= n

    of(500)
    assert seconds(lambda: of(16_000)) < 2.6 * seconds(lambda: of(8_000)) + 0.5


def test_tokens_that_later_values_hit(spark):
    """A number that a token holds is replaced within it, as replacements in turn do."""
    text = " ".join(f"x{i}@y.com" for i in range(150)) + " and 100"
    row = engines.gated(spark.createDataFrame([(text,)], "text string"), mode="tokenize").select("masked_text", F.col("spans")).first()
    mails_ = [f"x{i}@y.com" for i in range(150)]
    to = {m: f"<<EMAIL_ADDRESS_{i + 1:03d}>>" for i, m in enumerate(mails_)} | {"100": "<<CVV_001>>"}
    assert row.masked_text == in_turn(text, to.items()) and "<<EMAIL_ADDRESS_<<CVV_001>>>>" in row.masked_text


def test_table_of_a_whole_chunk(spark):
    """10,000 rows to a chunk, each with values of its own; columns of other kinds, with no order and with clashing names, stay."""
    rows = [(i, f"user{i}@mail.com" if i % 3 else None, f"n {i} user{i}@mail.com", {"k": i}, "kept") for i in range(12_000)]
    df = spark.createDataFrame(rows, "row_idx long, mail string, note string, m map<string,int>, chunk string").coalesce(1)
    out, found = tabular.sanitize_table(df, columns=["mail", "note"])
    assert out.columns == ["row_idx", *df.columns]
    began = time.time()
    got = out.toDF("number", *df.columns).collect()
    assert time.time() - began < 90
    assert sorted(r[0] for r in got) == list(range(12_000))
    for r in got:
        assert r["mail"] == ("[REDACTED]" if r["row_idx"] % 3 else "") and r["note"].endswith(" [REDACTED]") and r["m"] == {"k": r["row_idx"]} and r["chunk"] == "kept"
    assert {(r.chunk, r.column) for r in found.select("chunk", "column").collect()} == {(c, n) for c in (0, 1) for n in ("mail", "note")}
    assert tabular.sanitize_table(df.limit(0), columns=["mail"])[0].count() == 0


def test_sampled_heads(spark):
    df = spark.createDataFrame([("a@b.com",), ("x",), ("c@d.org and a@b.com",)], "note string").coalesce(1)
    out, _ = tabular.sanitize_table(df, sample=2)
    assert [r.note for r in out.orderBy("row_idx").collect()] == ["[REDACTED]", "x", "c@d.org and [REDACTED]"]


def test_statements_and_runs_with_many_values(spark):
    pairs = [(f"v{i}", f"<{i}>") for i in range(50)]
    entries = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(t).alias("to")) for v, t in pairs])
    df = spark.createDataFrame([("insert v1; insert v12 'v3;';", ["v1", "2 v", "40"])], "t string, runs array<string>")
    row = df.select(structured.mask_sql("t", entries).alias("s"), structured.mask_runs(F.col("runs"), entries).alias("r")).first()
    assert row.s == "insert <1>;\ninsert <12> '<3>;';" and row.r == ["<1>2 <40>", "", ""]
