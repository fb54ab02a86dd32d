"""Marked overlaps, merged texts and scripts, and texts put together by what neighbours share, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.operators import chunking, detect, stitching

R = random.Random(6)


def groups(text, n):
    out, size = [], 0
    for p in (p for p in text.split("\n\n") if p.strip()):
        if out and size + len(p) <= n:
            out[-1].append(p)
            size += len(p)
        else:
            out.append([p])
            size = len(p)
    return ["\n\n".join(g) for g in out]


def marked(own, n):
    before = lambda i: f"{own[i - 1][-n:]}\n{fixed.OVERLAP_BEFORE}\n" if i else ""
    after = lambda i: f"\n{fixed.OVERLAP_AFTER}\n{own[i + 1][:n]}" if i < len(own) - 1 else ""
    return [before(i) + g + after(i) for i, g in enumerate(own)]


def unmarked(content):
    if fixed.OVERLAP_BEFORE in content:
        content = content[content.index(fixed.OVERLAP_BEFORE) + len(fixed.OVERLAP_BEFORE) :].lstrip("\n")
    if fixed.OVERLAP_AFTER in content:
        content = content[: content.index(fixed.OVERLAP_AFTER)].rstrip("\n")
    return content


def test_marks_come_and_go(spark):
    texts = ["".join(R.choice(["a", "bb ", "é", "\n", "\n\n", " ", "."]) for _ in range(R.randint(0, 60))) for _ in range(300)] + ["", "\n\n\n\n", "x" * 50, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("g", stitching.paragraph_groups("t", 12))
    df = df.withColumn("m", stitching.marked(F.col("g"), 7)).withColumn("again", stitching.merged(F.col("m"))).withColumn("same", stitching.same_paragraphs("t", "again"))
    for r in df.collect():
        if r.t is None:
            assert r.g is None and r.again is None
            continue
        own = groups(r.t, 12)
        assert r.g == own and r.m == marked(own, 7)
        assert r.again == "\n\n".join(unmarked(c) for c in r.m) + "\n"
        count = lambda t: sum(bool(p.strip()) for p in t.split("\n\n"))
        assert tuple(r.same) == (count(r.t), count(r.again), count(r.t) == count(r.again))
    lost = spark.createDataFrame([("a\n\nb\n\nc", "a\n\nc\n")], "t string, again string").select(stitching.same_paragraphs("t", "again").alias("s")).first().s
    assert tuple(lost) == (3, 2, False)


def test_scripts_keep_their_header(spark):
    for header in ("-- dump\nSET names utf8;\n  # note\nUSE db;\n", "", "-- only\n"):
        statements = [f"insert {i};" for i in range(7)]
        script = header + "\n".join(statements)
        df = spark.createDataFrame([(script, statements)], "t string, s array<string>").withColumn("m", stitching.marked_statements(F.col("s"), 3))
        row = df.select("m", stitching.merged_script(F.col("m"), "t").alias("again"), stitching.script_header("t").alias("head")).first()
        assert len(row.m) == 3 and row.m[1].startswith("-- CONTEXT_OVERLAP_START\ninsert 1;\ninsert 2;\n-- CONTEXT_OVERLAP_END\n") and "AFTER_START\ninsert 6;\n" in row.m[1]
        assert row.head == header.rstrip()
        body = "\n\n".join("\n".join(statements[i : i + 3]) for i in (0, 3, 6)) + "\n"
        assert row.again == (header.rstrip() + "\n" + body if header else body)
        # A header that the chunks have kept is not put there twice.
        kept = spark.createDataFrame([([script], script)], "m array<string>, t string").select(stitching.merged_script(F.col("m"), "t").alias("again")).first().again
        assert kept == script.strip() + "\n"


def test_stitched(spark):
    rows = []
    for i in range(300):
        text = "".join(R.choice("ab") for _ in range(R.randint(0, 40)))
        cuts = sorted(R.sample(range(len(text) + 1), min(3, len(text) + 1)))
        parts = [text[max(a - R.randint(0, 6), 0) : b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        rows.append((i, parts))
    got = {r.i: r.t for r in spark.createDataFrame([*rows, (900, []), (901, None)], "i int, p array<string>").select("i", stitching.stitched(F.col("p"), 6).alias("t")).collect()}
    for i, parts in rows:
        out = ""
        for k, p in enumerate(parts):
            shared = max((n for n in range(min(6, len(p), len(parts[k - 1])) + 1) if parts[k - 1][len(parts[k - 1]) - n :] == p[:n]), default=0) if k else 0
            out += p[shared:]
        assert got[i] == out
    assert got[900] == "" and got[901] is None


def test_spans_count_once_or_as_often_as_found(spark):
    text = "".join(f"n{i} {1000 + i} " for i in range(60))
    chunks = chunking.with_context(chunking.fixed_width("t", 100), 30)
    df = spark.createDataFrame([(text,)], "t string").withColumn("f", stitching.chunk_spans(chunks, lambda x: detect.pattern_spans(x, [("N", "n", 0.9, r"\b[0-9]{4}\b")])))
    row = df.select("f", stitching.counted(F.col("f"), True).alias("all"), stitching.counted(F.col("f"), False).alias("once")).first()
    whole = {(m.start(), m.end(), m[0]) for m in re.finditer(r"\b[0-9]{4}\b", text)}
    assert {(s.start, s.end, s.value) for s in row.once} >= whole - {s for s in whole if s[0] % 100 > 96}
    assert len(row.all) > len(row.once) and {(s.start, s.end, s.value) for s in row.all} >= whole
    assert {x.idx for x in row.f} == set(range(-(-len(text) // 100)))
