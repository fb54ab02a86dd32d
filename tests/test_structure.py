"""Chunks, alignment, documents, encryption and streams."""

import hashlib
import hmac
import io
import zipfile

from pyspark.sql import functions as F

from veilspark.functions import crypto
from veilspark.operators import catalog, chunking, diff, structured, tabular
from veilspark.sources import readers, writers
from veilspark.streaming import jobs


def test_chunks(spark):
    text = "aa. bb. cc\n\ndd\n\n\nee"
    row = spark.createDataFrame([(text,)], "t string").select(chunking.pack_paragraphs("t", 5).alias("c"), chunking.sql_statements(F.lit("a 'x;y'; -- n;\nb;; c")).alias("s")).first()
    assert "".join(row.c) == text and all(len(c) <= 5 for c in row.c)
    assert row.s == ["a 'x;y';", "-- n;\nb;", ";", "c"]


def test_table_keeps_rows(spark):
    df = spark.createDataFrame([("a@b.com", "x 123"), ("c@d.org", None), ("plain", "")], "mail string, note string").coalesce(1)
    out, _ = tabular.sanitize_table(df, rows=2)
    assert [tuple(r)[1:] for r in out.orderBy("row_idx").collect()] == [("[REDACTED]", "x [REDACTED]"), ("[REDACTED]", ""), ("plain", "")]


def test_alignment(spark):
    rows = [("mail a@b.com and 1234 end", "mail <<EMAIL_ADDRESS_001>> and <<CVV_001>> end"), ("call 9876543210 now please ok", "call 9876****** now please ok"), ("same", "same")]
    got = spark.createDataFrame(rows, "o string, s string").select(diff.align("o", "s").alias("a")).collect()
    assert [(x.orig_start, x.orig_end, x.entity_type) for x in got[0].a] == [(5, 12, "EMAIL"), (17, 21, "CVV")]
    assert got[1].a[0].orig_start == 9 and got[2].a == []


def test_collapse(spark):
    rows = [(1, i, i in (1, 12)) for i in range(1, 13)]
    got = {(r.start_line, r.kind, r.end_line) for r in diff.collapse_runs(spark.createDataFrame(rows, "d int, line_no int, has_changes boolean"), "d").collect()}
    assert (5, "collapsed", 8) in got and len(got) == 9


def test_crypto(spark):
    key = F.lit("0123456789abcdef")
    row = spark.createDataFrame([("secret", "", None)], "a string, b string, c string").select(*[crypto.decrypt(crypto.encrypt(x, key), key).alias(x) for x in "abc"], crypto.hmac_sha256(F.lit("m"), "k").alias("h")).first()
    assert (row.a, row.b, row.c) == ("secret", "", None) and row.h == hmac.new(b"k", b"m", hashlib.sha256).hexdigest()


def test_docx(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>mail a@b</w:t></w:r><w:r><w:t>.com</w:t></w:r></w:p></w:body></w:document>")
    files = spark.createDataFrame([("x.docx", raw.getvalue()), ("bad", b"no")], "path string, content binary")
    found = readers.docx_paragraphs(files)
    entries = F.array(F.struct(F.lit("a@b.com").alias("value"), F.lit("[X]").alias("to")))
    row = found.select("part", "para_idx", structured.mask_runs(F.col("runs"), entries).alias("runs")).collect()
    assert [r.runs for r in row] == [["mail [X]", ""]]
    again = writers.rewrite_docx(raw.getvalue(), {(r.part, r.para_idx): r.runs for r in row})
    assert [x[2] for x in readers.paragraphs_of(again)] == [["mail [X]", ""]]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("PAN ABCDE1234F")
    q = jobs.sanitize_stream(jobs.text_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r.masked_text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["PAN [REDACTED]"]


def test_csv_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n01,"a ""b""\nc"\n2,NA\n3,\n')
    assert [tuple(r) for r in readers.csv_files(spark, str(tmp_path / "a.csv")).collect()] == [("01", 'a "b"\nc'), ("2", "NA"), ("3", "")]
    assert readers.csv_files_blanked(spark, str(tmp_path / "a.csv")).collect()[1].note == ""


def test_files_follow_their_plans(spark):
    from veilspark.operators import detect
    from veilspark.plans import engines

    asked = []

    def names(text):
        asked.append(text)
        return detect.no_names(text)

    rows = spark.createDataFrame([(1, "csv", "PAN ABCDE1234F"), (2, ".TXT", "PAN ABCDE1234F"), (3, "exe", "PAN ABCDE1234F"), (4, "png", None)], "id long, file_type string, text string")
    got = {r.id: r for r in engines.sanitize_files(rows, providers=engines.Providers(spacy=names)).collect()}
    assert got[1].masked_text == got[2].masked_text == "PAN [REDACTED]" and got[1].error is None
    assert (got[3].masked_text, got[3].error) == (None, "unknown file type") and got[4].error is None
    assert len(asked) == 2  # of the four combinations of the two layers given, those with names


def test_matches_take_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from veilspark.functions.core import matches

    def took(n):
        frame = spark.createDataFrame([("x12 " * n,)], "t string")
        best = []
        for _ in range(3):
            began = time.time()
            assert frame.select(matches(F.col("t"), "[0-9]+").alias("m")).select(F.size("m"), F.get("m", F.lit(n - 1))["start"]).first() == (n, 4 * n - 3)
            best.append(time.time() - began)
        return min(best)

    took(1000)
    assert took(64_000) < 2.6 * took(32_000) + 0.5


def test_json_parts(spark):
    rows = spark.createDataFrame([('["a \\"b\\"", {"z": 1, "a": [2]}, 1.50, null, true]', "[]"), ("[]", "[]"), ("no json", '["x"]')], "a string, b string")
    items = [r[0] for r in rows.select(structured.json_items("a")).collect()]
    assert items[:2] == [['"a \\"b\\""', '{"z":1,"a":[2]}', "1.5", "null", "true"], []]
    assert rows.where("b = '[]'").select(structured.json_merge(F.array(structured.json_items("a"), structured.json_items("b")))).first()[0] == '["a \\"b\\"",{"z":1,"a":[2]},1.5,null,true]'
    objects = spark.createDataFrame([(['{"k":1,"m":{"x":"y"}}', "{}", '{"n":[1,"2"],"k":"last"}'],), ([],)], "parts array<string>")
    assert [r[0] for r in objects.select(structured.json_update(F.col("parts"))).collect()] == ['{"k":"last","m":{"x":"y"},"n":[1,"2"]}', "{}"]


def test_looked_up(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    wanted = spark.createDataFrame([(2,), (2,), (7,), (None,)], "id long")
    assert sorted(map(tuple, catalog.looked_up(files, wanted).select("id", "name", "found").collect())) == [(2, "b", True), (7, None, False)]
    assert catalog.looked_up(files.limit(0), wanted.limit(0)).count() == 0


def test_row_numbers_of_a_sorted_table(spark):
    """Counting reads one column and numbering reads all, so that the partitions of a sorted table are put together differently in each."""
    from veilspark.operators import chunking

    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16kb", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1kb", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(4000).selectExpr("id * 7 % 4000 AS k", "concat(sha2(cast(id AS STRING), 512), sha2(cast(-id AS STRING), 512), sha2(cast(id * 3 AS STRING), 512), sha2(cast(id * 5 AS STRING), 512)) AS t").repartition(4).orderBy("k")
        rows = chunking.with_row_index(df).select("k", "t", "row_idx").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 4000 and all(r.k == r.row_idx for r in rows)


def test_chunks_are_searched_once(spark, small):
    """The plan holds each pattern once for a chunk's spans and masks, and packs a text once for all counts of it."""
    from veilspark import queries as own

    plan = lambda name: own.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    # A pattern is named by the pass that most texts take and twice by the one for texts that hold its sign.
    assert plan("chunked_engine").count("@(?:oksbi") == 3
    assert plan("merge_integrity").count("split(") == 2


def test_spans_are_worked_out_once_for_masks(spark, small):
    """Spans that are not yet a column stand once in a mask's plan (F23, F28), whatever is made of them."""
    from veilspark import queries as own

    for name in ("align_tokens", "detokenize", "mask_tokenize"):
        plan = own.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("@(?:oksbi") == 3, name


def test_spans_of_texts_with_signs(spark):
    """A text that holds the sign put around matches has the spans of the same text without it."""
    from veilspark.functions.core import SIGN, running
    from veilspark.operators import detect

    text = "# Aadhaar 5487 8795 5678 # 123 and 4567 # a@b.com # 10.0.0.1 #"
    rows = [[tuple(s) for s in r.s] for r in spark.createDataFrame([(text,), (text.replace("#", SIGN),)], "t string").select(detect.pattern_spans("t").alias("s")).collect()]
    assert rows[0] == rows[1] and len(rows[0]) > 5 and all(text[s[0] : s[2]] == s[4] for s in rows[0])
    sums = spark.sql("SELECT transform(sequence(1, n), x -> int(x)) AS a FROM VALUES (1), (2), (127), (128), (129), (300) AS v(n)").select("a", running(F.col("a")).alias("r"))
    assert all(r.r == [sum(r.a[: i + 1]) for i in range(len(r.a))] for r in sums.collect())


def test_lines_are_dealt_to_tasks_by_their_number(spark, small, monkeypatch):
    """tasks that sort lines grow in number with the table, and adaptive execution does not put them together."""
    from veilspark import queries as own

    n = spark.read.parquet(f"{small}/lineitem.parquet").count()
    monkeypatch.setattr(own, "TASK_LINES", n // 10, raising=False)
    assert own.queries()["collapse_runs"](spark, small).rdd.getNumPartitions() == -(-n // (n // 10))


def test_small_files_are_dealt_out_too(spark, tmp_path, monkeypatch):
    """Small files are read many to a task: their number alone does not deal rows out to the tasks they need."""
    from veilspark import queries as own

    monkeypatch.setattr(own, "TASK_ROWS", 40)
    spark.range(2000).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name").repartition(60).write.parquet(str(tmp_path / "customer.parquet"))
    read = own.table(spark, str(tmp_path), "customer")
    assert len(read.inputFiles()) >= 50 > read.rdd.getNumPartitions()
    dealt = own.records(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == 50 and dealt.count() == dealt.select("doc_id").distinct().count() == 2000


def test_zones_are_worked_out_once_for_all_points(spark):
    """Zones and points that are not columns yet stand once in the plan, whatever is made of them, and answers are those of each pair."""
    from veilspark.functions.core import inside

    rows = [(k, list(range(0, 40, 3)), [(a, a + k) for a in range(0, k * 5, 5)]) for k in range(1, 25)]
    df = spark.createDataFrame(rows, "k int, p array<int>, z array<struct<`from`:int,`to`:int>>")
    got = df.select("*", inside(F.filter("p", lambda p: p != 101), F.filter("z", lambda z: z["to"] != 202)).alias("hit"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" = 101") == 1 and plan.count(" = 202") == 1
    for row in got.collect():
        assert row.hit == [any(a <= p <= b for a, b in row.z) for p in row.p]
