"""The registered queries of the library's own operators, each over its whole tables.

The supplied tables hold few kinds of personal data and no catalog, so two views are made from them, by expressions that Spark and
DuckDB read alike: records (a text per customer with a value of every kind) and a catalog (files from documents, users from
customers, audit rows from events).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import crypto, fixed, mask
from veilspark.functions.core import matches, rows_of
from veilspark.functions.text import clean
from veilspark.operators import catalog, chunking, context, detect, diff, jsontext, masking, ocr, resolve, stitching, structured, summary, tabular
from veilspark.plans import config, engines
from veilspark.sources import readers, writers
from veilspark.streaming import jobs

#: Values of a record, by key k. Same text in both engines.
VALUES = {
    "aadhaar": "concat(cast(2000 + k % 8000 AS STRING), ' ', lpad(cast(k * 7 % 10000 AS STRING), 4, '0'), ' ', lpad(cast(k * 13 % 10000 AS STRING), 4, '0'))",
    "pan": "concat('ABC', chr(cast(65 + k % 26 AS INT)), chr(cast(65 + k * 3 % 26 AS INT)), lpad(cast(k % 10000 AS STRING), 4, '0'), chr(cast(65 + k * 5 % 26 AS INT)))",
    "phone": "concat('+91', cast(6000000000 + k * 7919 % 3999999999 AS STRING))",
    "email": "concat('user', cast(k AS STRING), '@mail', cast(k % 9 AS STRING), '.example.com')",
    "upi": "concat('user', cast(k AS STRING), '@oksbi')",
    "ifsc": "concat('SBIN0', lpad(cast(k % 1000000 AS STRING), 6, '0'))",
    "passport": "concat(chr(cast(65 + k % 26 AS INT)), cast(1000000 + k % 8999999 AS STRING))",
    "card": "concat('4', lpad(cast(k * 37 % 1000 AS STRING), 3, '0'), ' ', lpad(cast(k * 41 % 10000 AS STRING), 4, '0'), ' 1111 ', lpad(cast(k * 43 % 10000 AS STRING), 4, '0'))",
    "vid": "concat(lpad(cast(k * 3 % 10000 AS STRING), 4, '0'), '-2222-3333-', lpad(cast(k * 17 % 10000 AS STRING), 4, '0'))",
    "ip": "concat('10.', cast(k % 256 AS STRING), '.', cast(k * 7 % 256 AS STRING), '.', cast(k * 11 % 256 AS STRING))",
    "account": "cast(100000000000 + k * 104729 AS STRING)",
    "print": "md5(cast(k AS STRING))",
    "device": "concat('android-', substring(md5(cast(k AS STRING)), 1, 12))",
}
RECORD = (
    "concat('Name: ', c_name, '. Aadhaar: ', aadhaar, chr(10), 'PAN = ', pan, '; phone: ', phone, chr(10), 'Email: ', email, ' upi: ', upi, chr(10), 'IFSC ', ifsc, ' account: ', account, '. Passport: ', passport, chr(10), "
    "'card ', card, ' vid ', vid, ' ip ', ip, chr(10), 'Notes follow. No value stands in this line, nor in the next one. It only keeps the values above and below far apart from one another, as far as the zone of an identity anchor reaches and further, so that what comes after it has no company. ', 'The line goes on for long enough to be sure of that, with words that no pattern knows and no label either, up to its very end, which is here.', chr(10), "
    "'fingerprint: ', print, chr(10), 'device ', device, ' code ', lpad(cast(k % 1000 AS STRING), 3, '0'), ' on 1', cast(k % 9 + 1 AS STRING), '-0', cast(k % 9 + 1 AS STRING), '-1997', chr(10), 'total 1,234,567 ref 12_34_56 id 1l2 O5 ', cast(k % 90 + 10 AS STRING), 'O')"
)
FILE_FIELDS = {
    "id": "doc_id",
    "file_type": "CASE doc_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'csv' WHEN 2 THEN 'pdf' WHEN 3 THEN 'png' ELSE 'json' END",
    "name": "concat('Report_', cast(doc_id * 7919 % 1000 AS STRING), '_', source, '.', CASE doc_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'csv' WHEN 2 THEN 'pdf' WHEN 3 THEN 'png' ELSE 'json' END)",
    "size": "n_chars * 40000",
    "uploaded_by": "doc_id * 31 % 100 + 1",
    "status": "CASE WHEN doc_id % 10 = 0 THEN 'FAILED' WHEN doc_id % 10 = 1 THEN 'PROCESSING' ELSE 'DONE' END",
    "total_pii": "CASE WHEN doc_id % 10 > 1 THEN doc_id * 7 % 67 END",
    "pii_summary": "CASE WHEN doc_id % 10 > 1 THEN concat('{\"EMAIL_ADDRESS\":', cast(doc_id % 5 AS STRING), ',\"PAN\":', cast(doc_id % 3 AS STRING), ',\"IN_PHONE\":', cast(doc_id % 7 AS STRING), '}') ELSE 'oops' END",
    "layer_breakdown": "concat('{\"regex\":', cast(doc_id % 11 AS STRING), ',\"', CASE WHEN doc_id % 2 = 0 THEN 'spacy' ELSE 'presidio_spacy' END, '\":', cast(doc_id % 4 AS STRING), '}')",
    "uploaded_at": "doc_id * 1000",
    "processed_at": "CASE WHEN doc_id % 10 > 1 THEN doc_id * 7919 % 100000 END",
}
USER_FIELDS = {"id": "c_custkey", "name": "c_name", "email": "concat('u', cast(c_custkey AS STRING), '@example.com')", "role": "CASE WHEN c_custkey % 10 = 0 THEN 'ADMIN' ELSE 'USER' END", "created_at": "c_custkey * 10"}
AUDIT_FIELDS = {"id": "event_id", "user_id": "user_id % 100 + 1", "file_id": "CASE WHEN event_id % 3 = 0 THEN event_id END", "action": "event_type", "at": "event_id * 17"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def picked(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS {name}" for name, sql in fields.items()])


#: So many texts, about, are one task's work.
TASK_ROWS = 4096


def spread(df: DataFrame, key: Column | str) -> DataFrame:
    """Rows dealt out to tasks that grow in number with the table, and to all cores at least: work on texts is worth it.

    Tables of so many files that are read by as many tasks are not shuffled. Small files are read many to a task, so their number alone tells little.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df if len(df.inputFiles()) >= tasks and df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, key)


def values(spark: SparkSession, d: str) -> DataFrame:
    return _values(spread(table(spark, d, "customer").selectExpr("cast(c_custkey AS BIGINT) AS k", "c_name"), "k"))


def _values(customers: DataFrame) -> DataFrame:
    return customers.selectExpr("*", *[f"{sql} AS {n}" for n, sql in VALUES.items()])


def records(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, d).selectExpr("k AS doc_id", f"{RECORD} AS text")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def files(spark: SparkSession, d: str) -> DataFrame:
    return picked(table(spark, d, "documents"), FILE_FIELDS)


def users(spark: SparkSession, d: str) -> DataFrame:
    return picked(table(spark, d, "customer"), USER_FIELDS)


def audit(spark: SparkSession, d: str) -> DataFrame:
    return picked(table(spark, d, "events"), AUDIT_FIELDS)


def listed(docs: DataFrame, spans: Column) -> DataFrame:
    """Spans as rows, scores to six places, which both engines print alike."""
    out = rows_of(docs.withColumn("_s", spans), "_s", "doc_id")
    return out.select("doc_id", "ord", "entity_type", "start", F.col("end").alias("stop"), "value", F.round("score", 6).alias("score"))


def raw(docs: DataFrame) -> DataFrame:
    return docs.withColumn("spans", detect.pattern_spans("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# Detection


@query
def regex_detect_counts(spark, d):
    found = documents(spark, d).withColumn("spans", resolve.dedup_same_type(detect.pattern_spans("text")))
    return summary.type_summary(summary.long_form(found, "spans"))


@query
def regex_detect_spans(spark, d):
    return listed(records(spark, d), detect.pattern_spans("text"))


@query
def document_spans(spark, d):
    return listed(documents(spark, d), detect.pattern_spans("text"))


@query
def clean_text(spark, d):
    return records(spark, d).select("doc_id", clean("text", compose=False).alias("cleaned"))


@query
def clean_unicode(spark, d):
    dirty = F.concat(F.lit("é​  x–y"), F.col("text"))
    return documents(spark, d).select("doc_id", F.md5(F.regexp_replace(clean(dirty), "[^\\x00-\\x7F]", "#")).alias("cleaned"))


@query
def label_pairs(spark, d):
    return records(spark, d).select("doc_id", F.inline(detect.label_pairs("text"))).drop("label_end")


@query
def column_pii_type(spark, d):
    names = spark.createDataFrame([(n,) for n in ("aadhaar_no", "customer_phone", "emp_pan", "email_address", "full_name", "zip", "company", "c_custkey", "Date-Of-Birth", "notes")], "name string")
    return names.select("name", detect.column_type_of("name").alias("entity_type"))


#: Names of columns as tables have them; each row of the table below has one behind its own word.
COLUMN_NAMES = ("aadhaar_no", "phone", "emp-pan", "email_address", "full_name", "zip", "company", "Date-Of-Birth", "notes", "account", "pp_no", "credit_card")


@query
def column_types(spark, d):
    """Types that names tell, for a name from each customer."""
    k = F.col("c_custkey")
    name = F.concat_ws("_", F.lower("c_mktsegment"), F.element_at(F.array(*map(F.lit, COLUMN_NAMES)), (k % len(COLUMN_NAMES) + 1).cast("int")))
    return table(spark, d, "customer").select(k.alias("k"), name.alias("name")).withColumn("entity_type", detect.column_type_of("name"))


@query
def people_of_customers(spark, d):
    return readers.people_of(table(spark, d, "customer"), "c_custkey")


#: A masked form for each row, with its number where there is room for one.
MASKED = ("'<<PAN_' || k || '>>'", "'u***@m***.com'", "'98765*****'", "'+91 (22) ***-' || k", "'10.***.***.' || k", "'***.***.***.***'", "'XXXX XXXX XXXX 1234'", "'AB***1234F'", "'XXXX-XXXX-12'", "'[REDACTED]'", "'plain ' || k", "''", "'<<AADHAAR_VID_001>>'", "'****'")


@query
def mask_shapes(spark, d):
    """Types that the shapes of masked values tell."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    masked = F.expr("CASE k % " + str(len(MASKED)) + " " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(MASKED)) + " END")
    return rows.withColumn("masked", masked).withColumn("entity_type", diff.guess_type("masked"))


@query
def dealt_queues(spark, d):
    """Layers and types as often as they count, by either naming of the layers."""
    k = F.col("c_custkey")
    names = F.when(k % 2 == 0, F.create_map(F.lit("regex"), k % 3, F.lit("spacy"), k % 2, F.lit("bert"), k % 4)).otherwise(F.create_map(F.lit("regex"), k % 3, F.lit("presidio_spacy"), k % 4, F.lit("indic_bert"), k % 2))
    counts = F.create_map(F.lit("PAN"), k % 3, F.lit("IN_PHONE"), k % 2, F.lit("OTHER"), k % 4)
    return table(spark, d, "customer").select(k.alias("k"), F.array_join(diff.layer_queue(names), " ").alias("layers"), F.array_join(diff.type_queue(counts), " ").alias("types"))


@query
def context_word_boost(spark, d):
    return listed(raw(records(spark, d)), detect.context_words_boost("text", F.col("spans")))


@query
def source_labels(spark, d):
    rows = records(spark, d).select(F.inline(detect.labelled_sources(detect.pattern_spans("text"))))
    return rows.groupBy("entity_type", "layer").agg(F.count("*").alias("n"))


@query
def label_word_filter(spark, d):
    names = detect.gazetteer({"Name": "PERSON", "Email": "PERSON", "Notes": "LOCATION", "Customer": "PERSON"})
    rows = records(spark, d).select("doc_id", F.inline(detect.without_label_words(names(F.col("text")))))
    return rows.groupBy("entity_type", "value").agg(F.count("*").alias("n"))


@query
def label_boost(spark, d):
    return listed(raw(records(spark, d)), context.label_boost(F.col("spans"), detect.label_pairs("text")))


@query
def proximity_boost(spark, d):
    return listed(raw(records(spark, d)), context.proximity_boost(F.col("spans")))


@query
def anchor_rule(spark, d):
    out = rows_of(raw(records(spark, d)).withColumn("s", context.anchor_rule(F.col("spans"))), "s", "doc_id")
    return out.select("doc_id", "ord", F.round("score", 6).alias("score"), "slide6_boosted", "standalone_non_pii", "linked_to_identity")


@query
def density_boost(spark, d):
    return listed(raw(records(spark, d)), context.density_boost("text", F.col("spans")))


@query
def column_boost(spark, d):
    return listed(raw(records(spark, d)), context.column_boost(F.col("spans"), "account_no"))


@query
def dedup_any_type(spark, d):
    return listed(records(spark, d), resolve.dedup_any_type(detect.pattern_spans("text")))


@query
def dedup_same_type(spark, d):
    return listed(records(spark, d), resolve.dedup_same_type(detect.pattern_spans("text")))


# Summaries


def _resolved(spark, d):
    return summary.long_form(records(spark, d).withColumn("s", resolve.dedup_same_type(detect.pattern_spans("text"))), "s", "doc_id")


@query
def tiering(spark, d):
    return _resolved(spark, d).groupBy("entity_type", resolve.tier(F.col("score"), F.col("standalone_non_pii")).alias("tier")).agg(F.count("*").alias("n"))


@query
def type_summary(spark, d):
    return summary.type_summary(_resolved(spark, d), "doc_id")


@query
def layer_breakdown(spark, d):
    rows = _resolved(spark, d).withColumn("layer", F.when(F.col("ord") % 4 == 0, "indic_bert").when(F.col("ord") % 4 == 1, "other").otherwise(F.col("layer")))
    return summary.layer_breakdown(rows, "doc_id")


@query
def confidence_breakdown(spark, d):
    return summary.confidence_breakdown(_resolved(spark, d), "doc_id")


@query
def document_summary(spark, d):
    out = documents(spark, d).select("doc_id", summary.summary(resolve.dedup_same_type(detect.pattern_spans("text"))).alias("s"))
    return out.select("doc_id", "s.high", "s.medium", "s.total", F.coalesce(F.try_element_at("s.pii_summary", F.lit("CVV")), F.lit(0)).alias("cvv"), F.element_at("s.layer_breakdown", "regex").alias("regex"))


@query
def merge_chunk_summaries(spark, d):
    chunks = documents(spark, d).withColumn("s", summary.counts_by(detect.pattern_spans("text"), "entity_type")).withColumn("job", F.col("doc_id") % 7).withColumn("success", F.col("doc_id") % 5 != 0)
    return summary.merge_summaries(chunks, "s", "job", seed=("CVV", "UPI"))


@query
def chunk_status(spark, d):
    states = audit(spark, d).select((F.col("id") % 13).alias("job"), F.expr("CASE id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE CASE WHEN id % 8 = 3 THEN 'failed' ELSE 'pending' END END").alias("state"))
    return summary.chunk_status(states, "job")


@query
def job_success(spark, d):
    parts = audit(spark, d).select((F.col("id") % 50).alias("job"), (F.col("id") % 50 < 10).alias("failed"), F.when((F.col("id") % 50) % 2 == 0, 0).otherwise(1).alias("exif_count"))
    return summary.succeeded(parts, "job")


# Masking


@query
def mask_redact(spark, d):
    docs = records(spark, d).withColumn("s", resolve.dedup_any_type(detect.pattern_spans("text")))
    return docs.select("doc_id", masking.mask_positions("text", F.col("s")).getField("masked_text").alias("masked"))


@query
def mask_tokenize(spark, d):
    docs = records(spark, d).withColumn("s", resolve.dedup_any_type(detect.pattern_spans("text")))
    return docs.select("doc_id", masking.mask_positions("text", F.col("s"), "tokenize").getField("masked_text").alias("masked"))


@query
def token_map(spark, d):
    docs = records(spark, d).withColumn("s", resolve.dedup_any_type(detect.pattern_spans("text")))
    return docs.select("doc_id", F.explode(masking.token_map("text", F.col("s"))).alias("token", "value"))


@query
def detokenize(spark, d):
    docs = records(spark, d).withColumn("m", masking.mask_positions("text", resolve.dedup_any_type(detect.pattern_spans("text")), "tokenize"))
    return docs.select("doc_id", masking.detokenize(F.col("m.masked_text"), F.col("m.token_map")).alias("text"))


@query
def mask_partial(spark, d):
    v = values(spark, d).withColumn("place", F.concat_ws(", ", "c_name", F.lit(" Pune "))).withColumn("born", F.concat(F.lit("12/05/"), (1950 + F.col("k") % 80).cast("string")))
    kinds = {"email": "EMAIL_ADDRESS", "phone": "IN_PHONE", "card": "CREDIT_CARD", "aadhaar": "AADHAAR", "pan": "PAN", "c_name": "PERSON", "born": "DATE_TIME", "account": "ACCOUNT_NUMBER", "place": "LOCATION", "upi": "UPI"}
    return v.select("k", *[mask.partial_mask(c, F.lit(kind)).alias(f"m_{c}") for c, kind in kinds.items()])


@query
def value_map_replace(spark, d):
    docs = records(spark, d).withColumn("s", resolve.dedup_same_type(detect.pattern_spans("text")))
    return docs.select("doc_id", masking.replace_values("text", masking.value_map(F.col("s"))).alias("masked"))


@query
def replace_once(spark, d):
    entries = F.array(F.struct(F.lit("Aadhaar").alias("value"), F.lit("[A]").alias("to")), F.struct(F.lit("A").alias("value"), F.lit("<x>").alias("to")))
    return records(spark, d).select("doc_id", masking.replace_once("text", entries).alias("masked"))


@query
def gated_engine(spark, d):
    out = engines.gated(documents(spark, d))
    return out.select("doc_id", "masked_text", "summary.total")


@query
def contextual_engine(spark, d):
    out = engines.contextual(records(spark, d), compose=False, mode="mask", providers=engines.Providers(spacy=detect.gazetteer({"Customer": "PERSON"})))
    return out.select("doc_id", "masked_text", "high", "medium", "low")


@query
def documents_contextual(spark, d):
    """The contextual profile over every document, composition included."""
    return engines.contextual(documents(spark, d), mode="tokenize").select("doc_id", "masked_text", F.size("spans").alias("n_spans"), F.size("token_map").alias("n_tokens"), "high", "medium", "low")


@query
def documents_chunked(spark, d):
    """Every document in chunks of the size that the plan for texts has."""
    return engines.chunked(documents(spark, d)).select("doc_id", "masked_text", F.size("spans").alias("n_spans"), "n_chunks")


@query
def chunked_engine(spark, d):
    out = engines.chunked(records(spark, d), n=300)
    return out.select("doc_id", "masked_text", F.size("spans").alias("n_spans"), "n_chunks")


# Chunks


@query
def chunk_fixed(spark, d):
    rows = table(spark, d, "lineitem").withColumn("chunk", chunking.chunk_of(F.col("l_orderkey"), 1000))
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))


@query
def fixed_width(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(chunking.fixed_width("text", 700)).alias("idx", "text"))


@query
def chunk_overlap(spark, d):
    return documents(spark, d).select("doc_id", F.inline(chunking.with_context(chunking.fixed_width("text", 700), 50)))


@query
def neighbour_rows(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return chunking.neighbours(rows, "text", "turn", "conv_id", n=20).select("conv_id", "turn", "before", "after")


@query
def head_sample(spark, d):
    rows = table(spark, d, "orders").withColumn("chunk", chunking.chunk_of("o_orderkey", 1000)).where(chunking.head_sample("o_orderkey", 1000, 100))
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@query
def paragraph_pack(spark, d):
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return documents(spark, d).select("doc_id", F.posexplode(chunking.pack_paragraphs(text, 600)).alias("idx", "text"))


SCRIPT = "concat('INSERT INTO t VALUES (', cast(k AS STRING), ', ''a;b'');', chr(10), '-- note; more', chr(10), 'UPDATE t SET x = 1;; DELETE FROM t WHERE k = ', cast(k AS STRING))"


@query
def sql_statement_split(spark, d):
    return values(spark, d).selectExpr("k", f"{SCRIPT} AS script").select("k", F.posexplode(chunking.sql_statements("script", aware=False)).alias("idx", "statement"))


@query
def sql_statement_split_aware(spark, d):
    return values(spark, d).selectExpr("k", f"{SCRIPT} AS script").select("k", F.posexplode(chunking.sql_statements("script")).alias("idx", "statement"))


@query
def statement_context(spark, d):
    words = F.split("text", " ")
    return table(spark, d, "benchmark").select("item_id", F.inline(chunking.statement_context(words, 10))).select("item_id", "idx", F.array_join("before", ";").alias("before"), F.array_join("statements", ";").alias("own"), F.array_join("after", ";").alias("after"))


@query
def tile_grid(spark, d):
    images = table(spark, d, "part").select(F.col("p_partkey").alias("img_id"), (F.col("p_partkey") * 37 % 3000 + 2).cast("int").alias("w"), (F.col("p_partkey") * 53 % 2000 + 3).cast("int").alias("h"))
    return chunking.tiles(images)


@query
def merge_integrity(spark, d):
    return documents(spark, d).select("doc_id", F.inline(F.array(chunking.integrity("text", F.array_join(chunking.pack_paragraphs("text", 500), "")))))


@query
def overlap_marked(spark, d):
    return documents(spark, d).where("text IS NOT NULL").select("doc_id", F.posexplode(stitching.marked(stitching.paragraph_groups("text", 2000))).alias("idx", "content"))


@query
def overlap_merged(spark, d):
    docs = documents(spark, d).where("text IS NOT NULL").withColumn("again", stitching.merged(stitching.marked(stitching.paragraph_groups("text", 2000))))
    return docs.select("doc_id", "again", F.inline(F.array(stitching.same_paragraphs("text", "again"))))


@query
def scripts_merged(spark, d):
    """A script of statements per document, under a header that only the original has, marked in groups of three and merged."""
    body = F.transform(F.split("text", "\n", -1), lambda l: F.concat(F.lit("insert '"), F.regexp_replace(l, "[^a-z ]", ""), F.lit("';")))
    docs = documents(spark, d).where("text IS NOT NULL").withColumn("body", body).withColumn("script", F.concat(F.lit("-- dump\nSET x = 1\n\n"), F.array_join("body", "\n")))
    return docs.select("doc_id", stitching.merged_script(stitching.marked_statements(F.col("body"), 3), "script").alias("again"))


@query
def stitched_text(spark, d):
    """Texts cut into windows that repeat 500 signs of the next, and put together by what neighbours share."""
    parts = F.transform(chunking.with_context(chunking.fixed_width("text", 3000)), lambda c: F.concat(c["text"], c["after"]))
    return documents(spark, d).where("text IS NOT NULL").select("doc_id", stitching.stitched(parts).alias("again"))


def _dossiers(spark, d) -> DataFrame:
    """The records of a hundred customers as one text."""
    customers = table(spark, d, "customer").selectExpr("cast(c_custkey AS BIGINT) AS k", "c_name").withColumn("big", F.floor(F.col("k") / 100))
    # Customers are dealt out by dossier, so that grouping shuffles no text.
    rows = _values(spread(customers, "big")).selectExpr("big", "k AS doc_id", f"{RECORD} AS text").groupBy("big").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("own"))
    return rows.select(F.col("big").alias("doc_id"), F.array_join("own.text", "\n").alias("text"))


def _chunk_spans(spark, d) -> DataFrame:
    chunks = chunking.with_context(chunking.fixed_width("text", fixed.CHUNKS_SMALL["txt"]))
    return _dossiers(spark, d).withColumn("found", stitching.chunk_spans(chunks, engines.gated_spans))


@query
def chunk_union(spark, d):
    rows = rows_of(_chunk_spans(spark, d), "found", "doc_id")
    return rows.select("doc_id", "idx", "own", "span.entity_type", "span.start", F.col("span.end").alias("stop"), "span.value", F.round("span.score", 6).alias("score"))


@query
def chunk_summaries(spark, d):
    """Counts by type with overlaps counted as often as they are found, and once."""
    found = _chunk_spans(spark, d)
    # Each dossier is searched once for both counts.
    types = F.array(*[F.transform(stitching.counted(F.col("found"), overlap), lambda s: F.struct(s["entity_type"].alias("entity_type"), F.lit(overlap).alias("overlap"))) for overlap in (True, False)])
    rows = rows_of(found.withColumn("found", F.flatten(types)), "found", "doc_id")
    return rows.groupBy("doc_id", "entity_type", "overlap").agg(F.count("*").alias("n")).select("doc_id", "entity_type", "n", "overlap")


# Structured inputs


@query
def column_texts(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("nation"))
    return tabular.column_texts(rows, ["s_name", "nation"], "s_suppkey", rows=40, sample=15)


@query
def sanitize_table(spark, d):
    rows = values(spark, d).select("k", "email", "pan", F.concat_ws(" / ", "phone", "upi").alias("contact")).orderBy("k")
    return tabular.sanitize_table(rows, columns=["email", "pan", "contact"])[0].drop("row_idx")


@query
def json_root(spark, d):
    roots = table(spark, d, "nation").selectExpr("n_nationkey", "CASE n_nationkey % 3 WHEN 0 THEN concat(' [\"', n_name, '\"]') WHEN 1 THEN concat('{\"a\": \"', n_name, '\"}') ELSE concat('\"', n_name, '\"') END AS j")
    return roots.select("n_nationkey", structured.json_root("j").alias("root"))


@query
def json_leaf_mask(spark, d):
    rows = values(spark, d).select("k", F.struct(F.col("email").alias("mail"), F.col("k").alias("n"), F.array("pan", "upi").alias("ids")).alias("node"), "email", "pan")
    entries = F.array(*[F.struct(F.col(c).alias("value"), F.lit("[REDACTED]").alias("to")) for c in ("email", "pan")])
    kind = rows.schema["node"].dataType
    return rows.select("k", F.to_json(structured.mask_leaves(F.col("node"), kind, lambda v: masking.replace_values(v, entries))).alias("node"))


@query
def json_text_mask(spark, d):
    rows = values(spark, d).select("k", F.to_json(F.struct("k", "email", F.array("pan", "upi").alias("ids"))).alias("j"), F.array(F.struct(F.col("pan").alias("value"), F.lit("[PAN]").alias("to"))).alias("e"))
    return rows.select("k", structured.mask_json_text("j", F.col("e")).alias("j"))


@query
def run_mask(spark, d):
    runs = F.array(F.left("email", F.lit(4)), F.concat(F.substring("email", 5, 100), F.lit(" and ")), F.col("pan"))
    entries = F.array(*[F.struct(F.col(c).alias("value"), F.lit("[X]").alias("to")) for c in ("email", "pan")])
    return values(spark, d).select("k", F.posexplode(structured.mask_runs(runs, entries)).alias("run", "text"))


# Catalog


@query
def pii_distribution(spark, d):
    return catalog.distribution(files(spark, d))


@query
def layer_distribution(spark, d):
    return catalog.distribution(files(spark, d), "layer_breakdown")


@query
def top_files(spark, d):
    return catalog.top_files(files(spark, d))


@query
def dashboard_stats(spark, d):
    return catalog.dashboard(files(spark, d), users(spark, d))


@query
def recent_files(spark, d):
    return catalog.recent_files(files(spark, d), users(spark, d)).select("id", "name", "uploader", "uploader_email")


@query
def file_search(spark, d):
    own = files(spark, d)
    parts = [catalog.search(own, "REPORT_1", sort=s).limit(10).select(F.lit(s).alias("sort"), "id", "total_pii") for s in catalog.SORTS]
    parts.append(catalog.search(own, kind="image", pii="low").select(F.lit("image").alias("sort"), "id", "total_pii"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query
def file_page(spark, d):
    return catalog.page(catalog.search(files(spark, d), sort="name-az"), 3, 10).select("id", "name")


@query
def page_info(spark, d):
    return catalog.page_info(catalog.search(files(spark, d)), 3)


@query
def admin_search(spark, d):
    return catalog.admin_search(files(spark, d), users(spark, d), " #00000001 ").select("id", "name", "uploader")


@query
def audit_page(spark, d):
    return catalog.page(catalog.audit_trail(audit(spark, d), users(spark, d), files(spark, d)), 2, 50).select("id", "action", "user_email", "file_name")


@query
def audit_by_action(spark, d):
    return catalog.audit_trail(audit(spark, d), users(spark, d), files(spark, d), "click").groupBy("user_id").agg(F.count("*").alias("n"), F.count("file_name").alias("with_file"))


@query
def user_file_counts(spark, d):
    return catalog.user_file_counts(users(spark, d), files(spark, d)).select("id", "name", "files")


@query
def viewer_rollup(spark, d):
    return catalog.viewer_rollup(files(spark, d))


@query
def layer_names_merged(spark, d):
    return files(spark, d).select("id", F.inline(F.array(catalog.layers_of(catalog.counts_of("layer_breakdown")))))


@query
def role_projection(spark, d):
    return catalog.for_role(files(spark, d), "USER")


@query
def download_names(spark, d):
    return catalog.download(files(spark, d))


@query
def upload_filter(spark, d):
    good, bad = catalog.accepted(files(spark, d).select("id", F.when(F.col("id") % 7 == 0, F.concat("name", F.lit(".exe"))).otherwise(F.col("name")).alias("name"), "size"))
    return good.select("id", F.lit("ok").alias("verdict")).union(bad.select("id", F.col("reason").alias("verdict")))


@query
def update_results(spark, d):
    own = files(spark, d)
    new = own.where("status = 'PROCESSING'").select("id", (F.col("id") % 9).alias("total_pii"), F.when(F.col("id") % 4 == 1, "broken").alias("error"))
    return catalog.update_results(own, new).select("id", "status", "total_pii")


@query
def delete_files(spark, d):
    gone = files(spark, d).where("id % 6 = 0").select("id")
    return catalog.delete_files(files(spark, d), audit(spark, d), gone)[1].select("id", "file_id")


@query
def delete_users(spark, d):
    return catalog.delete_users(users(spark, d), files(spark, d), users(spark, d).where("role = 'ADMIN'").select("id"))[1].select("id", "uploaded_by")


# What masking has changed


def _masked(spark, d):
    return documents(spark, d).withColumn("masked", F.regexp_replace("text", "[0-9]{3,}", "[REDACTED]"))


@query
def diff_lines(spark, d):
    return diff.diff_lines(_masked(spark, d), "text", "masked", "doc_id")


#: So many lines, about, are one task's work where they are sorted within their documents.
TASK_LINES = 500_000


def _lined(spark, d):
    # Dealt out by document to tasks that grow in number with the table: partitions by size would hold ever more rows, and each sorts all of its own.
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // TASK_LINES))
    rows = lines.repartition(tasks, "l_suppkey").select(F.col("l_suppkey").alias("doc_id"), F.row_number().over(_by("l_suppkey", "l_orderkey", "l_linenumber")).alias("line_no"), (F.col("l_orderkey") % 11 == 0).alias("has_changes"), F.col("l_shipdate").cast("string").alias("original"), F.lit("x").alias("sanitized"))
    return rows


def _by(key, *order):
    from pyspark.sql.window import Window

    return Window.partitionBy(key).orderBy(*order)


@query
def collapse_runs(spark, d):
    return diff.collapse_runs(_lined(spark, d), "doc_id")


@query
def unified_view(spark, d):
    return diff.unified(diff.diff_lines(_masked(spark, d), "text", "masked", "doc_id")).select("doc_id", "line_no", "side", "text")


@query
def occurrences(spark, d):
    rows = summary.long_form(raw(records(spark, d)), "spans", "doc_id").select("doc_id", "ord", "entity_type", "value", "start")
    return diff.occurrences(rows, "doc_id", start="ord").select("doc_id", "ord", "occurrence", "occurrences")


@query
def line_number(spark, d):
    rows = rows_of(raw(records(spark, d)), "spans", "doc_id", "text").select("doc_id", "ord", diff.line_number("text", "start").alias("line_no"))
    return rows


@query
def viewer_labels(spark, d):
    rows = table(spark, d, "nation").select(F.element_at(F.array(*map(F.lit, [*fixed.ALL_TYPES, "ODD"])), (F.col("n_nationkey") % 20 + 1).cast("int")).alias("kind"), F.element_at(F.array(*map(F.lit, ["regex", "spacy", "bert", "rule_based", "my_layer"])), (F.col("n_nationkey") % 5 + 1).cast("int")).alias("layer"), F.col("n_nationkey").alias("k"))
    return rows.select("k", diff.viewer_type("kind").alias("viewer"), diff.type_label("kind").alias("label"), diff.layer_name("layer").alias("layer_name"), diff.chart_layer("layer").alias("chart"), diff.confidence_color(F.col("k") / 25).alias("color"), diff.short_name(F.concat(F.lit("a rather long name "), F.col("k").cast("string"))).alias("short"))


@query
def align_tokens(spark, d):
    docs = records(spark, d).withColumn("m", masking.mask_positions("text", resolve.dedup_any_type(detect.pattern_spans("text")), "tokenize"))
    return docs.select("doc_id", F.inline(diff.align("text", F.col("m.masked_text"))))


@query
def align_anchors(spark, d):
    docs = records(spark, d).withColumn("m", F.regexp_replace("text", "[0-9]{4,}", "****"))
    return docs.select("doc_id", F.inline(diff.align("text", "m")))


@query
def synthesize_entities(spark, d):
    docs = records(spark, d).withColumn("m", F.regexp_replace("text", "[0-9]{4,}", "****")).withColumn("t", F.create_map(F.lit("PAN"), F.lit(2), F.lit("UPI"), F.lit(1))).withColumn("l", F.create_map(F.lit("regex"), F.lit(1), F.lit("spacy"), F.lit(2)))
    return rows_of(diff.synthesize(docs, "text", "m", "t", "l"), "entities", "doc_id")


@query
def entities_found_again(spark, d):
    """Values between words that are known again, masked by tokens and by stars: entities with types, layers and confidence from the two texts alone."""
    v = values(spark, d)
    text = F.concat(F.lit("Aadhaar: "), "aadhaar", F.lit(" | PAN is "), "pan", F.lit(" | mail to "), "email", F.lit(" | that is all"))
    forms = {"tokens": F.lit("Aadhaar: <<AADHAAR_001>> | PAN is <<PAN_001>> | mail to <<EMAIL_ADDRESS_001>> | that is all"), "stars": F.concat(F.lit("Aadhaar: **** | PAN is ***** | mail to u***@m***.com | that is all"))}
    counts = {"t": F.create_map(F.lit("PAN"), F.lit(1), F.lit("UPI"), F.lit(2)), "l": F.create_map(F.lit("regex"), F.lit(1), F.lit("spacy"), F.lit(1))}
    parts = [diff.synthesize(v.select("k", F.lit(name).alias("form"), text.alias("text"), masked.alias("m")).withColumns(counts), "text", "m", "t", "l") for name, masked in forms.items()]
    return rows_of(parts[0].union(parts[1]), "entities", "k", "form").withColumnRenamed("end", "stop")


@query
def segmented_lines(spark, d):
    docs = records(spark, d).withColumn("m", F.regexp_replace("text", "[0-9]{4,}", "****")).withColumn("t", F.create_map(F.lit("PAN"), F.lit(2))).withColumn("l", F.create_map(F.lit("regex"), F.lit(1)))
    return diff.synthesize(docs, "text", "m", "t", "l").select("doc_id", F.inline(diff.segmented("text", "m", "entities"))).select("doc_id", "line_no", "has_changes", F.size("original").alias("n_original"), F.size("sanitized").alias("n_sanitized"))


def _nested(spark, d) -> DataFrame:
    """Every document as JSON of a shape that no operator is told: its lines are elements two levels down."""
    lines = F.split("text", "\n", -1)
    return documents(spark, d).where("text IS NOT NULL").select("doc_id", F.to_json(F.struct(F.struct("doc_id", F.array(F.struct(lines.alias("lines"), F.lit("en").alias("tag"))).alias("parts")).alias("doc"), F.array().cast("array<int>").alias("none"))).alias("j"))


@query
def json_any_leaves(spark, d):
    return _nested(spark, d).select("doc_id", F.inline(jsontext.leaves("j")))


@query
def json_any_mask(spark, d):
    entries = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(to).alias("to")) for v, to in (("the", "[T]"), ("1", "[1]"), ("doc", "[D]"))])
    return _nested(spark, d).select("doc_id", structured.mask_json_text("j", entries, indent=2).alias("j"))


@query
def ciphertext_forms(spark, d):
    """Values in each of three forms read by one function; every seventh ciphertext has another's tag."""
    key, rows = F.lit("0123456789abcdef0123456789abcdef"), values(spark, d).select("k", F.concat_ws(" ", "email", "pan").alias("plain"))
    nonce = F.unhex(F.md5(F.col("k").cast("string").cast("binary")))
    forms = rows.withColumn("dots", crypto.encrypt_dotted("plain", key)).withColumn("colons", crypto.encrypt_colons("plain", key, nonce)).withColumn("own", crypto.encrypt("plain", key))
    wrong = F.concat_ws(":", F.split_part("colons", F.lit(":"), F.lit(1)), F.base64(F.unhex(F.md5("plain"))), F.split_part("colons", F.lit(":"), F.lit(3)))
    forms = forms.withColumn("colons", F.when(F.col("k") % 7 == 0, wrong).otherwise(F.col("colons")))
    return forms.select("k", *[crypto.read_any(c, key).alias(c) for c in ("dots", "colons", "own", "plain")])


@query
def json_like_original(spark, d):
    """JSON written again as its original is: indented where that is, the order of keys and the spelling of numbers kept."""
    rows = values(spark, d).withColumn("o", F.when(F.col("k") % 2 == 0, F.concat(F.lit('{\n  "z": 1.50,\n  "a": [\n    "'), "email", F.lit('"\n  ]\n}'))).otherwise(F.concat(F.lit('{"z": 1.50, "a": ["'), "email", F.lit('"]}'))))
    squeezed = F.concat(F.lit('{"z":1.50,"a":["'), F.col("email"), F.lit('"]}'))
    return rows.select("k", writers.json_like(squeezed, "o").alias("j"))


@query
def json_sanitized(spark, d):
    rows = values(spark, d).select("k", F.to_json(F.struct("k", F.struct("email", F.array(F.col("pan"), F.lit("plain"), F.lit(" "), F.array_join(F.array("upi", "pan"), " / ")).alias("list")).alias("contact"))).alias("j"))
    done = structured.sanitize_json(rows, "j")
    return done.select("k", "masked_json", F.size("leaves").alias("n_leaves"), F.array_join(F.transform(F.filter("leaves", lambda x: F.size(x["spans"]) > 0), lambda x: x["path"]), " ").alias("paths"))


#: Numbers, each masked by one sign, and what stands around them, which overlaps them and is not found in the masked text.
NUMBERS, AROUND = "[0-9]{2,}", "[A-Za-z]+ [0-9]+"


@query
def line_segments(spark, d):
    """Both sides of every document, cut at the borders of entities that overlap."""
    entity = lambda kind, masked: lambda m, i: F.struct(F.concat(F.lit(kind), i.cast("string")).alias("id"), F.lit(kind).alias("entity_type"), m["start"].alias("start"), m["end"].alias("end"), F.lit(masked).alias("masked"))
    own = F.concat(F.transform(matches(F.col("text"), NUMBERS), entity("N", "\x01")), F.transform(matches(F.col("text"), AROUND), entity("W", "\x02")))
    docs = documents(spark, d).where("text IS NOT NULL").withColumn("own", own).withColumn("masked", F.regexp_replace("text", NUMBERS, "\x01"))
    lines = docs.select("doc_id", F.inline(diff.segmented("text", "masked", "own")))
    side = lambda name: lines.select("doc_id", "line_no", "has_changes", F.lit(name).alias("side"), F.posexplode(name).alias("seg_no", "s"))
    return side("original").union(side("sanitized")).select("doc_id", "line_no", "has_changes", "side", "seg_no", "s.*")


# Images

#: Twenty orders are an image, so that images grow in number with the table and not in size.
WORDS = {"img_id": "cast(floor(l_orderkey / 20) AS BIGINT)", "text": "concat('w', cast(l_partkey % 50 AS STRING))", "confidence": "l_quantity / 50", "x": "cast(l_partkey * 3 % 60 AS INT)", "y": "cast(l_suppkey * 7 % 40 AS INT)", "width": "cast(10 + l_linenumber * 3 AS INT)", "height": "cast(8 + l_linenumber AS INT)"}


def _words(spark, d, engine: str) -> DataFrame:
    side = "l_linenumber <= 3" if engine == "first" else "l_linenumber > 3"
    return picked(table(spark, d, "lineitem").where(side), WORDS).withColumn("engine", F.lit(engine))


@query
def ocr_merge(spark, d):
    return ocr.merge_words(_words(spark, d, "first"), _words(spark, d, "second"))


@query
def reading_text(spark, d):
    return ocr.reading_text(_words(spark, d, "first").union(_words(spark, d, "second")))


@query
def bbox_match(spark, d):
    named = _words(spark, d, "first").select("img_id", F.concat(F.lit("W"), (F.col("img_id") % 50).cast("string"), F.lit("!")).alias("value")).distinct()
    return ocr.boxes(named, _words(spark, d, "second"))


@query
def tile_dedup(spark, d):
    return ocr.tile_dedup(_words(spark, d, "first").select("img_id", F.col("engine").alias("entity_type"), F.col("text").alias("value")))


@query
def dominant_engine(spark, d):
    return ocr.dominant_engine(_words(spark, d, "first").union(_words(spark, d, "second")))


@query
def exif_text(spark, d):
    k = F.col("s_suppkey")
    lat, lon = ocr.degrees(k % 90, k % 60, (k % 7) * 1.5, F.when(k % 2 == 0, "S").otherwise("N")), ocr.degrees(k % 180, k % 30, F.lit(0.0), F.lit("E"))
    fields = F.create_map(F.lit("Artist"), F.col("s_name"), F.lit("Model"), F.when(k % 3 == 0, " ").otherwise("M1"))
    for name in ocr.EXIF_FIELDS:
        if name not in ("Artist", "Model"):
            fields = F.map_concat(fields, F.create_map(F.lit(name), F.lit("")))
    return table(spark, d, "supplier").select("s_suppkey", ocr.exif_text(lat, lon, fields).alias("text"))


@query
def focused_view(spark, d):
    """Changed lines only."""
    docs = table(spark, d, "documents").withColumn("masked", F.regexp_replace("text", "[0-9]{3,}", "[REDACTED]"))
    return diff.focused(diff.diff_lines(docs, "text", "masked", "doc_id")).select("doc_id", "line_no", "original", "sanitized")


@query
def confident_words(spark, d):
    """Recognised words above a confidence, of all orders."""
    words = _words(spark, d, "first").union(_words(spark, d, "second"))
    return ocr.confident(words, 0.5).groupBy("img_id", "engine").agg(F.count("*").alias("n"))


# Encryption, plans, sources, streams

KEY = "0123456789abcdef0123456789abcdef"


@query
def encrypt_roundtrip(spark, d):
    c = crypto.encrypt("c_name", F.lit(KEY))
    rows = table(spark, d, "customer").select("c_custkey", "c_name", c.alias("c"))
    return rows.select("c_custkey", crypto.decrypt("c", F.lit(KEY)).alias("plain"), crypto.is_encrypted("c").alias("encrypted"), crypto.decrypt("c", F.lit(KEY[::-1])).alias("wrong_key"), crypto.decrypt("c_name", F.lit(KEY)).alias("passed_on"))


@query
def encryption_probe(spark, d):
    rows = table(spark, d, "customer").withColumn("c", F.when(F.col("c_custkey") % 2 == 0, crypto.encrypt("c_name", F.lit(KEY))).otherwise(F.col("c_name")))
    return crypto.probe(rows, "c")


@query
def encryption_verdicts(spark, d):
    """The probe's three answers: of a column without values, of one that is encrypted throughout, and of ones that are in part or not at all."""
    key, k = F.lit(KEY), F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.lit(None).cast("string").alias("none"), crypto.encrypt("c_name", key).alias("all"), F.when(k % 3 == 0, crypto.encrypt("c_name", key)).when(k % 3 == 1, F.col("c_name")).alias("some"), F.when(k % 2 == 0, crypto.encrypt("c_name", key)).alias("blanks"), F.col("c_name").alias("plain"))
    parts = [crypto.probe(rows, c).select(F.lit(c).alias("field"), "verdict") for c in rows.columns]
    return functools.reduce(DataFrame.union, parts)


@query
def signed_requests(spark, d):
    return table(spark, d, "nation").select("n_nationkey", crypto.hmac_sha256("n_name", "secret").alias("signature"))


@query
def pipeline_plan(spark, d):
    return files(spark, d).withColumn("p", config.plan_column("file_type", F.col("size") / (1024.0 * 1024.0))).select("id", "p.rule", "p.chunk_size", "p.use_bert")


@query
def sanitize_files(spark, d):
    rows = documents(spark, d).withColumn("file_type", F.when(F.col("doc_id") % 2 == 0, "txt").otherwise("odd"))
    return engines.sanitize_files(rows).select("doc_id", "masked_text", "error")


@query
def people(spark, d):
    return readers.people(spark, 1000)


@query
def pii_report(spark, d):
    rows = summary.long_form(raw(records(spark, d)), "spans").select("entity_type", F.col("value").alias("original"), F.lit("[REDACTED]").alias("masked"), F.col("score").alias("confidence"), "layer")
    return writers.pii_report(rows)


@query
def joined_chunks(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("chunk_idx"), "text")
    return writers.joined_chunks(rows, "conv_id")


@query
def audit_counts(spark, d):
    return jobs.audit_counts(table(spark, d, "events").select("ts", "event_type")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


# Gates, leaves, lookups and what else is not in a query above


@query
def size_gates(spark, d):
    return files(spark, d).select("id", chunking.needs_chunking("size").alias("chunked"), chunking.valid_size("size").alias("valid"))


@query
def paragraph_pack_whole(spark, d):
    """Paragraphs are never cut."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return documents(spark, d).select("doc_id", F.posexplode(chunking.pack_paragraphs(text, 600, sentences=False)).alias("idx", "text"))


@query
def tile_grid_plain(spark, d):
    images = table(spark, d, "part").select(F.col("p_partkey").alias("img_id"), (F.col("p_partkey") * 37 % 3000 + 2).cast("int").alias("w"), (F.col("p_partkey") * 53 % 2000 + 3).cast("int").alias("h"))
    return chunking.tiles(images, overlap=0)


@query
def files_by_age(spark, d):
    own, now = files(spark, d).withColumn("processed_at", F.timestamp_seconds(F.col("processed_at") * 400)), F.timestamp_seconds(F.lit(31536000))
    parts = [catalog.search(own, since=since, now=now).select(F.lit(since).alias("since"), "id") for since in (*catalog.DAYS, "ever")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query
def types_seen(spark, d):
    return catalog.types_seen(summary.long_form(raw(documents(spark, d)), "spans"))


@query
def exif_hits(spark, d):
    rows = values(spark, d).selectExpr("k", f"{RECORD} AS text", "concat('Artist: ', email, '; ', pan) AS exif")
    return rows.select("k", ocr.exif_hits(F.col("exif"), detect.pattern_spans("text")).alias("hits"))


@query
def encrypted_fields(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", crypto.encrypt_json(F.struct("c_name", "c_custkey"), F.lit(KEY)).alias("j"))
    hidden = crypto.encrypt_fields(rows, ["c_name", "c_mktsegment"], F.lit(KEY)).withColumn("hidden", crypto.is_encrypted("c_name") & crypto.is_encrypted("c_mktsegment") & crypto.is_encrypted("j"))
    shown = crypto.decrypt_fields(hidden, ["c_name", "c_mktsegment"], F.lit(KEY)).withColumn("node", crypto.decrypt_json("j", F.lit(KEY), "c_name string, c_custkey long"))
    return shown.select("c_custkey", "c_name", "c_mktsegment", "hidden", F.col("node.c_name").alias("node_name"), F.col("node.c_custkey").alias("node_key"))


@query
def fresh_requests(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", crypto.hmac_sha256("n_name", "secret").alias("signature"))
    check = lambda key: crypto.verified(F.col("n_name"), F.col("signature"), F.col("n_nationkey") * 3, F.lit(40), key)
    return rows.select("n_nationkey", check("secret").alias("accepted"), check("other").alias("forged"))


@query
def insert_files(spark, d):
    new = table(spark, d, "orders").select((-F.col("o_orderkey")).alias("id"), F.concat(F.lit("new_"), F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("name"), F.lit("txt").alias("file_type"))
    return catalog.insert_files(files(spark, d), new).select("id", "name", "status", "total_pii")


@query
def files_looked_up(spark, d):
    return catalog.looked_up(files(spark, d), audit(spark, d).select(F.col("file_id").alias("id"))).select("id", "name", "found")


@query
def report_json(spark, d):
    rows = summary.long_form(raw(records(spark, d)), "spans", "doc_id")
    out = rows.select("doc_id", "ord", F.col("ord").alias("id"), "entity_type", F.col("value").alias("original"), F.lit("[REDACTED]").alias("masked"), "start", "end", F.col("score").alias("confidence"), "layer")
    return out.select("doc_id", "ord", writers.pii_report_json_column().alias("json"))


@query
def json_leaf_detection(spark, d):
    """Leaves by path, each detected and masked on its own; blank ones are left out."""
    rows = values(spark, d).select("k", F.to_json(F.struct("email", F.struct("pan", F.lit(" ").alias("blank")).alias("inner"))).alias("j"))
    leaves = structured.json_leaves("j", {"email": "$.email", "inner.pan": "$.inner.pan", "inner.blank": "$.inner.blank", "none": "$.none"})
    found = rows.select("k", F.inline(leaves))
    return found.select("k", "path", masking.replace_values("value", masking.value_map(engines.gated_spans(F.col("value")))).alias("masked"))


@query
def json_array_parts(spark, d):
    """Arrays of JSON taken apart and put together again."""
    rows = values(spark, d).select("k", F.concat(F.lit('["'), "email", F.lit('", {"z": 1, "a": "x"}, null]')).alias("a"), F.concat(F.lit("["), F.col("k").cast("string"), F.lit(", true]")).alias("b"))
    return rows.select("k", structured.json_merge(F.array(structured.json_items("a"), structured.json_items("b"))).alias("j"))


@query
def json_object_parts(spark, d):
    rows = values(spark, d).select("k", F.array(F.concat(F.lit('{"z":1,"mail":"'), "email", F.lit('"}')), F.concat(F.lit('{"a":2,"z":'), F.col("k").cast("string"), F.lit("}"))).alias("parts"))
    return rows.select("k", structured.json_update(F.col("parts")).alias("j"))


@query
def json_indent(spark, d):
    rows = table(spark, d, "nation").selectExpr("n_nationkey", "concat('{', CASE WHEN n_nationkey % 2 = 0 THEN chr(10) ELSE '' END, '  \"a\": \"', n_name, '\"}') AS j")
    return rows.select("n_nationkey", structured.json_indent("j").alias("indent"))


@query
def replace_in_order(spark, d):
    """Values replaced in the order of their detection, not the longest first."""
    entries = F.array(F.struct(F.lit("A").alias("value"), F.lit("<x>").alias("to")), F.struct(F.lit("Aadhaar").alias("value"), F.lit("[A]").alias("to")))
    return records(spark, d).select("doc_id", masking.replace_values("text", entries, longest=False).alias("masked"))


@query
def time_left(spark, d):
    jobs_ = chunk_status(spark, d)
    return jobs_.select("job", F.round(summary.seconds_left("done", "total", F.col("job") * 60), 6).alias("seconds"))


@query
def entities_of_type(spark, d):
    rows = summary.long_form(raw(records(spark, d)), "spans", "doc_id")
    return diff.of_type(rows, "PAN").select("doc_id", "ord", "value")


@query
def page_values(spark, d):
    """Distinct values of all texts on a page of fifty."""
    rows = summary.long_form(raw(records(spark, d)).withColumn("page", F.floor(F.col("doc_id") / 50)), "spans", "page")
    return masking.distinct_values(rows, "page")


@query
def file_ids(spark, d):
    return values(spark, d).select("k", chunking.file_id(F.concat("print", F.lit("_report"))).alias("file_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
