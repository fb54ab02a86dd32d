"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.core import let
from veilspark.llm import embedding_dedup, fim, langid, mixing, ngram_join, packing, periodic, pii, quality_classifier, quality_rules, secret_scan, suffix_dedup, warc
from veilspark.llm.common import remainder


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; every machine has the package that holds them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, folder, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).drop("spans")


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked(table(spark, folder, "documents"))


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.digest(F.col("base")), 256).alias("base_sha256"), secret_scan.digest(F.col("spans")).alias("spans"))


def op6_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.pfair_mix(docs).drop("text")


def op7_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    pieces = vocabulary("piece_bpe_32k.model")
    langs, p = langid.learn(docs.where(~F.col("held_out")), pieces)
    return langid.identify(docs, langs, p, pieces, ["doc_id", "held_out"])


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 3) == 1)
    labels = table(spark, folder, "labels").where(remainder("doc_id", 3) != 1)
    w = quality_classifier.learn(docs, labels)
    return quality_classifier.score(docs, w, ["doc_id", "held_out"])


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.write(table(spark, folder, "pages"))
    records = warc.read(index, payloads=False)
    return records.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one text of ten, by the id's hash, the words from some place on repeat those at that place, as the contract has it."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n == 0, "").otherwise(let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda at: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < at["a"], i).otherwise(at["a"] + (i - at["a"]) % at["p"]))), " ")))

    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, planted)).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.find(with_planted_runs(table(spark, folder, "documents")), ["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    best = found.withColumn("_best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) div -_best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    moved = fim.transform(table(spark, folder, "documents"), ["doc_id"])
    back = fim.restore(F.col("output"), F.col("form"))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_suffix_dedup, op4_ngram_jaccard_join, op5_secret_scan, op6_pfair_mixing, op7_embedding_near_dedup, op8_language_id, op9_pii, op10_quality_classifier, op11_warc, op12_periodic_runs, op13_fill_in_middle)}
#: Where SQL can express a query: all pairs are compared, and links are followed to their end.
REACHED = "r AS (SELECT {key} AS node, {key} AS reach FROM {table} UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a) SELECT d.{key}, (SELECT count(*) FROM l WHERE l.a = d.{key}) AS n_links, m.c AS component_id, m.c = d.{key} AS kept FROM {table} d JOIN (SELECT node, min(reach) AS c FROM r GROUP BY node) m ON m.node = d.{key}"
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": "WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents), "
    "g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), "
    "p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)), " + REACHED.format(key="doc_id", table="documents"),
    "op11_warc": "SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN f END AS refers_to FROM (SELECT *, n >= 100 AND f IS NOT NULL AND page_id IS DISTINCT FROM f AS again "
    "FROM (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY sha256(h)) AS f FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)))",
    # crc32 bit by bit: each byte is followed by eight -1, at which a bit is shifted out. Runs are stretches of six-word grams that come again at one distance.
    "op12_periodic_runs": "WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS o, xor(4294967295, list_reduce(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), "
    "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, CAST(4294967295 AS BIGINT))) AS h FROM documents), "
    "a AS (SELECT doc_id, o, len(o) AS n, h, (h // 10) % greatest(len(o), 1) AS a, h // 10 AS g FROM d), "
    "w AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE o END AS w FROM a), "
    "s AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(0, len(w) - 5)) AS i FROM w WHERE len(w) >= 12)), "
    "p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i), "
    "r AS (SELECT doc_id, a AS start, n + 5 + q AS length, min(q) AS period FROM (SELECT doc_id, q, min(i) AS a, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM p) GROUP BY doc_id, q, k) WHERE n + 5 >= q AND n + 5 + q >= 12 GROUP BY ALL), "
    "m AS (SELECT doc_id, min(period) AS period, start, length FROM r GROUP BY doc_id, start, length), "
    "u AS (SELECT doc_id, count(*) AS n_runs, arg_min({'start': start, 'length': length, 'period': period}, (-length, start, period)) AS b, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs FROM m GROUP BY doc_id), "
    "k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT w.doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS x FROM w) z WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = z.doc_id AND z.i >= m.start + m.period AND z.i < m.start + m.length) GROUP BY doc_id) "
    "SELECT w.doc_id, coalesce(u.n_runs, 0) AS n_runs, u.b.start AS start, u.b.length AS length, u.b.period AS period, 1000 * u.b.length // u.b.period AS exponent_milli, sha256(coalesce(u.runs, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256 FROM w LEFT JOIN u USING (doc_id) LEFT JOIN k USING (doc_id)",
    "op13_fill_in_middle": "SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256 FROM ("
    "SELECT *, substring(t, 1, lo) AS p, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1) AS s, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM ("
    "SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substring(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8 * i + 1, 8) AS BIGINT)) AS h FROM documents)))",
    "op7_embedding_near_dedup": "WITH RECURSIVE l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.98), " + REACHED.format(key="vec_id", table="embeddings"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
