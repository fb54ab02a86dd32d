"""One file in the order of the rows, byte by byte against a table library's writer."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark.sources import readers, writers

R = random.Random(8)


def test_csv_of_50000_rows(spark, tmp_path):
    cells = ["plain", "", 'say "x"', "a,b", "line\nend", " é ", None, "'", "\r", "😀"]
    rows = [(i, R.choice(cells), str(i), R.choice(cells)) for i in range(50_000)]
    df = spark.createDataFrame(rows, "row_idx long, `na me` string, n string, `q,uote` string").repartition(7)
    path = tmp_path / "out.csv"
    writers.write_csv(df, str(path))
    want = pd.DataFrame([r[1:] for r in rows], columns=["na me", "n", "q,uote"]).to_csv(index=False, lineterminator="\n")
    assert path.read_bytes() == want.encode()
    assert os.listdir(tmp_path) == ["out.csv"]
    back = readers.csv_files(spark, str(path))
    assert back.columns == ["na me", "n", "q,uote"] and back.count() == 50_000
    # Written again, the file is replaced; parts in a folder, one after another, are the same bytes.
    writers.write_csv(df.limit(0), str(path))
    assert path.read_text() == 'na me,n,"q,uote"\n'
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    writers.write_ordered(df.select("row_idx", "`na me`", "n", "`q,uote`"), str(tmp_path / "parts"), single=False)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(os.listdir(tmp_path / "parts"))
    assert len(names) > 1 and b"".join((tmp_path / "parts" / n).read_bytes() for n in names) == want.encode()


def test_lines_and_what_exists(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "row_idx int, t string")
    writers.write_ordered(df, str(tmp_path / "x"), kind="lines")
    assert (tmp_path / "x").read_text() == "a\n\nc\n"
    with pytest.raises(Exception, match="FileExists"):
        df.drop("row_idx").write.format("ordered_file").option("kind", "lines").mode("append").save(str(tmp_path / "x"))
    assert (tmp_path / "x").read_text() == "a\n\nc\n" and os.listdir(tmp_path) == ["x"]


def test_failed_writes_leave_nothing(spark, tmp_path):
    (tmp_path / "x").write_text("old")
    bad = spark.range(100, numPartitions=4).select(F.col("id").alias("row_idx"), F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise("a").alias("t"))
    with pytest.raises(Exception, match="broken"):
        writers.write_ordered(bad, str(tmp_path / "x"), kind="lines")
    assert (tmp_path / "x").read_text() == "old"


def test_json_is_indented_as_it_was(spark):
    x = {"a": [1, {"b": "é"}, []], "c": None}
    originals = [json.dumps(x, ensure_ascii=False, indent=2), json.dumps(x, ensure_ascii=False), json.dumps(x, ensure_ascii=False, indent="\t"), "no"]
    df = spark.createDataFrame([(o, json.dumps(x)) for o in originals[:3]] + [("no", "no")], "o string, t string")
    assert [r.j for r in df.select(writers.json_like("t", "o").alias("j")).collect()] == [originals[0], originals[1], originals[0], None]
