"""Broken files among others, headers of images and tables, and streams with late, early and repeated rows."""

import datetime
import struct
import time
import zlib

from pyspark.sql import functions as F

from veilspark.plans import engines
from veilspark.sources import readers
from veilspark.streaming import jobs


def test_one_broken_file_costs_its_own_row(spark):
    rows = [("a.txt", "txt", b"PAN ABCDE1234F"), ("b.json", "json", b"{broken"), ("c.docx", "docx", b"no zip"), ("d.exe", "exe", b"x"), ("e.txt", "txt", None), ("f.TXT", ".TXT", b"mail x@y.com \xff"), ("g.csv", "csv", b"")]
    rows += [(f"n{i}.txt", "txt", f"n {i} x{i}@y.com".encode()) for i in range(40)]
    files = spark.createDataFrame(rows, "name string, file_type string, content binary").repartition(3)
    done = engines.process_files(files)
    got = {r.name: r for r in done.collect()}
    assert len(got) == len(rows)
    assert got["a.txt"].masked_text == "PAN [REDACTED]" and got["f.TXT"].masked_text == "mail [REDACTED] �" and got["g.csv"].masked_text == "" and got["n7.txt"].masked_text == "n 7 [REDACTED]"
    assert {n for n, r in got.items() if r.error} == {"b.json", "c.docx", "d.exe", "e.txt"} and all(r.masked_text is None for r in got.values() if r.error)
    assert got["b.json"].error.startswith("JSONDecodeError") and got["c.docx"].error.startswith("BadZipFile") and got["d.exe"].error == "unknown file type" and got["e.txt"].error == "no content"
    # Those that failed alone are processed again, here with a reader that takes broken JSON for a text; no other file is read.
    refuse = lambda c: 1 / 0
    again = engines.retried(done, files, extractors={"json": bytes.decode, "docx": refuse})
    after = {r.name: r for r in again.collect()}
    assert len(after) == len(rows) and {n for n, r in after.items() if r.error} == {"c.docx", "d.exe", "e.txt"}
    assert after["b.json"].masked_text == "{broken" and after["a.txt"].masked_text == "PAN [REDACTED]" and after["c.docx"].error.startswith("ZeroDivisionError")


def test_files_are_tried_again_by_themselves(spark):
    files = spark.createDataFrame([(f"{i}.txt", "txt", f"t{i}".encode()) for i in range(5)], "name string, file_type string, content binary").coalesce(1)
    seen = set()

    def flaky(content):
        """Fails once for each file, then reads it."""
        if content not in seen:
            seen.add(content)
            raise OSError("not yet")
        return content.decode()

    text = lambda attempts: {(r.text, r._error) for r in readers.extracted_text(files, {"txt": flaky}, attempts).collect()}
    assert text(1) == {(None, "OSError: not yet")} and text(2) == {(f"t{i}", None) for i in range(5)}


def test_report_of_a_text(spark):
    row = engines.detect_text(spark, "Contact: PAN ABCDE1234F, mail x@y.com, number 1234").first()
    assert {d.type for d in row.detected} >= {"PAN", "EMAIL_ADDRESS"} and "[REDACTED]" in row.masked_text
    assert row.pii_summary == {k: sum(d.type == k for d in row.detected) for k in {d.type for d in row.detected}}
    assert set(row.layer_breakdown) == {"regex", "presidio_spacy", "indic_bert"} and sum(row.layer_breakdown.values()) == len(row.detected)
    assert row.confidence_breakdown.high + row.confidence_breakdown.medium == len(row.detected)
    assert engines.detect_text(spark, "", profile="gated").first().masked_text == ""


def png(w, h):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))


def jpeg(w, h):
    segment = lambda kind, data: bytes([0xFF, kind]) + struct.pack(">H", len(data) + 2) + data
    return b"\xff\xd8" + segment(0xE0, b"JFIF" + bytes(9)) + segment(0xC4, bytes(20)) + b"\xff" + segment(0xC2, struct.pack(">BHHB", 8, h, w, 3) + bytes(9))


def test_image_headers(spark):
    rows = [("p", png(640, 400)), ("j", jpeg(33, 70_00)), ("cut p", png(1, 1)[:20]), ("cut j", jpeg(5, 5)[:45]), ("gif", b"GIF89a"), ("empty", b""), ("none", None)]
    got = {r.name: (r.width, r.height, r.size_error is None) for r in readers.image_sizes(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got["p"] == (640, 400, True) and got["j"] == (33, 7000, True)
    assert all(got[n] == (None, None, False) for n in ("cut p", "cut j", "gif", "empty", "none"))


def test_tables_that_may_be_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n")
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("id,v\n")
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path)).collect()] == [("1", "x")]
    assert readers.csv_table(spark, str(tmp_path / "c.csv")).count() == 0 and readers.csv_table(spark, str(tmp_path / "c.csv")).columns == ["id", "v"]
    assert readers.csv_table(spark, str(tmp_path / "b.csv")).columns == []


def test_stream_of_signed_requests(spark, tmp_path):
    """Rows that are too old, from the future, or sent again, over several batches, and the states of the query as a table."""
    base = datetime.datetime(2024, 1, 1, 12, 0, 0)
    at = lambda s: base + datetime.timedelta(seconds=s)
    schema = "signature string, at timestamp, sent timestamp"
    batches = [[("a", at(0), at(-1)), ("b", at(1), at(-40)), ("c", at(2), at(10))], [("a", at(3), at(2)), ("d", at(4), at(4))], [("d", at(6), at(5)), ("e", at(7), at(6))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    progress = jobs.Progress(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    checked = jobs.first_seen(stream, late="30 seconds").where((F.col("at").cast("double") - F.col("sent").cast("double")).between(-5, 30))
    query = checked.writeStream.format("parquet").queryName("requests").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.signature for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "d", "e"]
    for _ in range(50):
        states = [r.state for r in progress.table().where("name = 'requests'").collect()]
        if states and states[-1] == "ended":
            break
        time.sleep(0.2)
    progress.stop()
    rows = progress.table().where("state = 'running'").collect()
    assert states[0] == "started" and states[-1] == "ended" and sum(r.rows for r in rows) == 7 and sum(r.rows > 0 for r in rows) == 3
