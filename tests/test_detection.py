"""Spans, context, resolution and masks against known results and against plain Python."""

import random
import re

from pyspark.sql import functions as F

from veilspark.functions import fixed, mask
from veilspark.functions.core import SPAN, matches, rows_of
from veilspark.functions.text import clean
from veilspark.operators import detect, masking, resolve
from veilspark.plans import config, engines

GOLDEN = {
    "Aadhaar: 5487 8795 5678\nPAN: ABCDE1234F": ([("AADHAAR", 9, 23, 0.95), ("CVV", 9, 13, 0.4), ("CVV", 14, 18, 0.4), ("CVV", 19, 23, 0.4), ("PAN", 29, 39, 0.95)], "Aadhaar: [REDACTED]\nPAN: [REDACTED]"),
    "Phone: +919876543210, alt +91 98765 43210": ([("IN_PHONE", 7, 20, 0.95), ("AADHAAR", 8, 20, 0.75), ("ACCOUNT_NUMBER", 8, 20, 0.65), ("IN_PHONE", 30, 41, 0.6)], "Phone: [REDACTED], alt +91 [REDACTED]"),
    "IFSC SBIN0001234 a/c 123456789012 upi rahul@oksbi mail rahul@gmail.com ip 10.0.0.1": ([("IFSC", 5, 16, 0.95), ("ACCOUNT_NUMBER", 21, 33, 0.65), ("UPI", 38, 49, 0.95), ("EMAIL_ADDRESS", 55, 70, 0.9), ("IP_ADDRESS", 74, 82, 0.85)], "IFSC [REDACTED] a/c [REDACTED] upi [REDACTED] mail [REDACTED] ip [REDACTED]"),
}


def test_golden_spans(spark):
    docs = spark.createDataFrame([(t,) for t in GOLDEN], "text string")
    for row in engines.gated(docs).select("text", "spans", "masked_text").collect():
        spans, masked = GOLDEN[row.text]
        assert [(s.entity_type, s.start, s.end, s.score) for s in row.spans] == spans
        assert row.masked_text == masked


def test_offsets_equal_finditer(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("a1 2é😀.\n@x") for _ in range(r.randint(0, 40))) for _ in range(60)]
    for pattern in (r"\d+", r"[a-z]+@?", r"[^.!?\n]+[.!?\n]?"):
        got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", matches(F.col("t"), pattern).alias("m")).collect()
        for row in got:
            assert [(m.start, m.end, m.value) for m in row.m] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, texts[row.i])]


def fold(spans, same):
    out = []
    for s in sorted(spans, key=lambda s: (s[0], s[1])):
        hit = next((k for k, a in enumerate(out) if s[0] < a[2] and s[2] > a[0] and (not same or s[3] == a[3])), None)
        if hit is None:
            out.append(s)
        elif s[4] > out[hit][4] or (same and s[4] == out[hit][4] and fixed.LAYER_PRIORITY.get(s[5], 0) > fixed.LAYER_PRIORITY.get(out[hit][5], 0)):
            out[hit] = s
    return sorted(out, key=lambda s: s[0])


def test_folds_equal_plain_loops(spark):
    r = random.Random(2)
    cases = [[(a := r.randint(0, 30), i, a + r.randint(1, 12), r.choice("AB"), r.choice((0.5, 0.7, 0.9)), r.choice(("regex", "spacy", "bert"))) for i in range(r.randint(0, 9))] for _ in range(120)]
    rows = [(k, [(s[0], s[1], s[2], s[3], "v", s[4], s[5], *[False] * 7) for s in spans]) for k, spans in enumerate(cases)]
    df = spark.createDataFrame(rows, f"k int, s array<{SPAN}>")
    for row in df.select("k", resolve.dedup_any_type(F.col("s")).alias("a"), resolve.dedup_same_type(F.col("s")).alias("b")).collect():
        for got, same in ((row.a, False), (row.b, True)):
            assert [(s.start, s.ord, s.end, s.entity_type, s.score, s.layer) for s in got] == fold(cases[row.k], same)


MASKS = [
    ("rahul.sharma@gmail.com", "EMAIL_ADDRESS", "r***@g***.com"), ("a@b", "EMAIL_ADDRESS", "a***@***"), ("+919876543210", "IN_PHONE", "9876******"), ("09876543210", "PHONE_NUMBER", "9876******"),
    ("4111 1111 1111 1234", "CREDIT_CARD", "**** **** **** 1234"), ("5487 8795 9012", "AADHAAR", "**** **** 9012"), ("ABCDE1234F", "PAN", "AB***4F"), ("AB", "PAN", "[REDACTED]"), ("Rahul Sharma", "PERSON", "Rahul S****"),
    ("Madonna", "PERSON", "M****"), ("12/05/1997", "DATE_TIME", "**/**/1997"), ("123456781234", "ACCOUNT_NUMBER", "********1234"), ("123 MG Road, Bengaluru", "LOCATION", "[STREET REDACTED], Bengaluru"), ("Bengaluru", "LOCATION", "[REDACTED]"), ("x@oksbi", "UPI", "[REDACTED]"),
]


def test_partial_masks(spark):
    rows = spark.createDataFrame(MASKS, "v string, kind string, want string").select("want", mask.partial_mask("v", "kind").alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_clean_and_columns(spark):
    t = "  x​ 1,234‑5 12_3 1l2 O5 12-05-1997\n\n\n\nend\t\t. "
    got = spark.createDataFrame([(t,)], "t string").select(clean("t")).first()[0]
    assert got == "x 1 234-5 12-3 112 05 12/05/1997\n\nend ."
    names = {"aadhaar_no": "AADHAAR", "customer_phone": "IN_PHONE", "emp_pan": "PAN", "email_address": "EMAIL_ADDRESS", "full_name": "PERSON", "notes": None}
    assert {n: detect.column_type(n) for n in names} == names


def test_contextual_round_trip(spark):
    docs = spark.createDataFrame([("Name: Asha Rao mail asha@x.com PAN: ABCDE1234F born 12/05/1997",)], "text string")
    row = engines.contextual(docs, mode="tokenize", providers=engines.Providers(spacy=detect.gazetteer({"Asha Rao": "PERSON"}))).withColumn("back", masking.detokenize(F.col("masked_text"), F.col("token_map"))).first()
    assert "<<PERSON_001>>" in row.masked_text and row.back == row.cleaned_text


def test_plans():
    assert config.plan_for("csv", 99).rule == "A" and config.plan_for("txt", 5.0).rule == "C" and config.plan_for("txt", 5.1).rule == "B" and config.plan_for(".PNG", 1).rule == "D"
    try:
        config.plan_for("md", 1)
        raise AssertionError
    except ValueError:
        pass


def test_registered_pattern(spark):
    before = len(detect.catalog())
    assert not detect.register_pattern("BAD", "broken", "([", 0.5)
    with detect.registering():
        assert detect.register_pattern("BADGE", "badge", r"\bB-[a-z]{4}\b", 0.9, ["badge"])
        row = spark.createDataFrame([("no digits, B-abcd",)], "text string").select(detect.pattern_spans("text").alias("s")).first()
        assert [(s.entity_type, s.value) for s in row.s] == [("BADGE", "B-abcd")] and len(detect.catalog()) == before + 1
    assert len(detect.catalog()) == before and "BADGE" not in detect.fixed.CONTEXT_WORDS


def test_quicker_patterns_match_the_same(spark):
    """Each pattern as it is searched for, against the catalog's own form, over texts dense in values and near misses, signs of \x01 included."""
    dice = random.Random(3)
    parts = ["2345 6789 0123", "2345-6789-0123", "2345.6789.0123", "2345/6789/0123", "234567890123", "ABCDE1234F", "+91 9876543210", "09876543210", "98765 43210", "9876-543210", "987 6543210", "user.x@oksbi", "SBIN0123456", "A1234567", "1111 2222 3333 4444", "1111-2222-3333-4444", "4111 1111 1111 1111", "5211111111111111", "6011-1111-1111-1111", "37121111 1111 1111", "123", "1234", "fp_hash_abcd1234", "face_tmp_abcd1234", "0123456789abcdef" * 2, "android-0123abcd", "ios-0123abcd", "01234567-89ab-1cde-8f01-23456789abcd", "a.b@c-d.org", "10.0.255.3", "é", "x", "_", " ", "\n", "-", ".", "/", "@", "\x01", "7", "Z"]
    texts = ["".join(dice.choice(parts) + dice.choice(["", "", " ", "x", "_"]) for _ in range(dice.randrange(25))) for _ in range(600)]
    assert all(any(re.search(p[3], t) for t in texts) for p in fixed.PATTERNS)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    own = F.array(*[F.struct(F.lit(p[0]).alias("kind"), F.regexp_extract_all("text", F.lit(p[3]), F.lit(0)).alias("found")) for p in fixed.PATTERNS])
    want = F.flatten(F.transform(own, lambda x: F.transform(x["found"], lambda v: F.concat_ws(":", x["kind"], v))))
    got = F.transform(detect.pattern_spans("text"), lambda s: F.concat_ws(":", s["entity_type"], s["value"]))
    whole = F.forall(detect.pattern_spans("text"), lambda s: F.substring("text", s["start"] + 1, s["end"] - s["start"]) == s["value"])
    assert df.select((got == want).alias("same"), whole.alias("whole")).where("NOT same OR NOT whole").count() == 0


def test_spans_as_rows_are_searched_once(spark, small):
    """No test on the spans stands below the dealing out of rows, where one task would search every text before it is dealt."""
    from veilspark import queries as own

    for name in ("regex_detect_spans", "anchor_rule", "line_number", "type_summary", "chunk_union"):
        plan = own.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Filter" in line and "RLIKE" in line for line in plan.split("\n")) == 0, name
    rows = spark.createDataFrame([(1, [(1, "a"), (2, "b")]), (2, []), (3, None)], "k int, s array<struct<n:int,t:string>>")
    assert [tuple(r) for r in rows_of(rows, "s", "k").orderBy("n").collect()] == [(1, 1, "a"), (1, 2, "b")]


def test_quick_labels_match_the_same(spark):
    """Labels as they are searched for, against their plain pattern: letters beyond ASCII that equal one of ASCII where case does not count included."""
    dice = random.Random(5)
    parts = [*fixed.LABELS, *map(str.upper, fixed.LABELS), "\u017fpouse", "\u0130P", "\u0131fsc", "\u212aard", "pp no", "e-mai", "k", "\n", "x", "9"]
    texts = ["".join(dice.choice(parts) + dice.choice([":", " = ", " : ", ": v", " ", ""]) for _ in range(dice.randrange(20))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    same = [F.regexp_extract_all("t", F.lit(detect.QUICK_LABELS), F.lit(k)) == F.regexp_extract_all("t", F.lit(detect.LABEL_PATTERN), F.lit(k)) for k in range(4)]
    assert df.where(~(same[0] & same[1] & same[2] & same[3])).count() == 0
    assert df.where(F.regexp_extract("t", detect.QUICK_LABELS, 1).rlike("[\u017f\u0130\u0131]")).count() > 0


def test_digits_are_taken_once():
    """A phone's digits are searched once for its mask, not for each look at them."""
    assert str(mask.mask_phone(F.col("v"))).count("regexp_replace") == 1 and str(mask.mask_account(F.col("v"))).count("regexp_replace") == 1


def test_patterns_are_searched_at_once(spark):
    """Most patterns are found by one search: a text is not read again for each of them."""
    plan = spark.createDataFrame([("x 123",)], "text string").select(detect.pattern_spans("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.lower().count("regexp_replace(") <= 2 * (1 + len(detect.ALONE)) < len(fixed.PATTERNS)


def test_group_and_length_tell_the_pattern():
    assert sorted(detect.ALONE + [detect._PLACES[name] for g in detect.GROUPS for name in g]) == list(range(len(fixed.PATTERNS)))
    for g in detect.GROUPS:
        lengths = [n for own in g.values() for n in own]
        assert len(lengths) == len(set(lengths)) and max(lengths) <= detect.LONGEST


def test_overlaps_of_one_pattern_are_left_out(spark):
    """Rows of values that overlap others of their pattern, short ones and one longer than what is put one behind another, against each pattern's own search."""
    chains = ["2345 " * 9, "2345-" * 7, "2345." * 5, "2345/" * 6, "98765 " * 5, "4111-" * 9 + "1", "1.2.3.4.5.6.7.8.9.10.11.12", "+919876543210+919876543210", "2345 6789 0123\u03012345 6789 0123", "\u00e92345 6789 0123", "\x012345 6789\x01 2345 6789 2345\x01", "4111 11111111 1111 1111 4111", "2345 " * 3000]
    df = spark.createDataFrame([(t,) for t in chains], "text string")
    of = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), m["start"], m["end"], m["value"])
    own = F.flatten(F.array(*[F.transform(matches(F.col("text"), p[3]), of(p[0])) for p in fixed.PATTERNS]))
    got = F.transform(detect.pattern_spans("text"), lambda s: F.struct(s["entity_type"].alias("kind"), s["start"], s["end"], s["value"]))
    assert df.select((own == got).alias("same"), F.size(got).alias("n")).where("NOT same OR n = 0").count() == 0


def test_parts_with_one_winner_are_not_folded(spark):
    """A first span that meets all others of its part and is beaten by none stays alone, and is not walked through; so do later ones where it does not."""
    texts = ["Aadhaar: 5487 8795 5678", "card 4111 1111 1111 1111", "+919876543210", "10.0.0.1 1234 5678"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("s", detect.pattern_spans("text"))
    for row in df.select("s", resolve.dedup_any_type(F.col("s")).alias("a")).collect():
        own = [(s.start, s.ord, s.end, s.entity_type, s.score, s.layer) for s in row.s]
        assert [(s.start, s.ord, s.end, s.entity_type, s.score, s.layer) for s in row.a] == fold(own, False)
    assert "forall(" in df.select(resolve.dedup_any_type(F.col("s")))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_token_map_needs_no_masked_text(spark):
    df = spark.createDataFrame([("PAN: ABCDE1234F and PAN ABCDE1234G, a@b.org",), ("none",), (None,)], "text string").withColumn("s", resolve.dedup_any_type(detect.pattern_spans("text")))
    rows = df.select(masking.mask_positions("text", F.col("s"), "tokenize")["token_map"].alias("want"), masking.token_map("text", F.col("s")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and len(rows[0].got) == 3
