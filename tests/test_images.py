"""The queries over words in images take every order: held against their registered SQL."""

import duckdb
import pytest

from veilspark import oracle
from veilspark import queries as own

@pytest.fixture(scope="module")
def later(spark, tmp_path_factory):
    """A part of the orders, early and late ones."""
    place = tmp_path_factory.mktemp("later")
    spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").where("l_orderkey BETWEEN 2500 AND 4500").write.parquet(str(place / "lineitem.parquet"))
    return str(place)


@pytest.mark.parametrize("name", ["ocr_merge", "bbox_match", "tile_dedup", "dominant_engine", "reading_text"])
def test_all_orders(spark, later, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{later}/lineitem.parquet/*.parquet')")
    ran = c.execute(oracle.oracle_sql()[name])
    names = [x[0] for x in ran.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(str([plain(v) for v in r]) for r in ran.fetchall())
    got = sorted(str([plain(r[n]) for n in names]) for r in own.queries()[name](spark, later).collect())
    assert got == want and got
    assert own._words(spark, later, "first").count() + own._words(spark, later, "second").count() == spark.read.parquet(f"{later}/lineitem.parquet").count()
