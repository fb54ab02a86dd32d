"""A selection of registered queries against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from veilspark import oracle
from veilspark import queries as own

CHOSEN = ("label_pairs", "mask_partial", "fixed_width", "chunk_overlap", "paragraph_pack", "tile_grid", "pii_distribution", "file_search", "audit_page", "diff_lines", "collapse_runs", "ocr_merge", "exif_text", "json_leaf_mask", "encrypt_roundtrip", "pipeline_plan", "run_mask", "update_results", "size_gates", "tile_grid_plain", "files_by_age", "files_looked_up", "insert_files", "encrypted_fields", "fresh_requests", "json_array_parts", "json_object_parts", "json_indent", "replace_in_order", "time_left", "file_ids", "line_segments", "json_any_leaves", "json_any_mask", "json_sanitized", "json_like_original", "overlap_marked", "overlap_merged", "scripts_merged", "stitched_text", "chunk_union", "chunk_summaries", "ciphertext_forms", "encryption_verdicts", "column_types", "people_of_customers", "mask_shapes", "dealt_queues", "entities_found_again")


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for name in os.listdir(small):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{name}')")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, small, name):
    df = own.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    ran = duck.execute(oracle.oracle_sql()[name])
    names = [x[0] for x in ran.description]
    assert sorted(names) == columns
    want = sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in ran.fetchall())
    assert got == want and got


def test_profiles_over_whole_documents(spark, small):
    """A document of one chunk is masked as a whole one is, and what tokens stand for gives the cleaned text back."""
    whole = {r.doc_id: r for r in own.queries()["gated_engine"](spark, small).collect()}
    chunked = own.queries()["documents_chunked"](spark, small).collect()
    assert len(chunked) == len(whole)
    for r in chunked:
        if r.n_chunks == 1:
            assert (r.masked_text, r.n_spans) == (whole[r.doc_id].masked_text, whole[r.doc_id].total)
    for r in own.queries()["documents_contextual"](spark, small).collect():
        assert r.n_spans == r.high + r.medium + r.low and r.n_tokens <= r.high + r.medium


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(own.queries()) > 80
