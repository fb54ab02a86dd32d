"""Queries over processed files, their users and the audit trail, and the changes of those tables.

files: id, name, file_type, size, uploaded_by, status, total_pii, pii_summary, layer_breakdown (JSON), uploaded_at, processed_at.
users: id, name, email, role, created_at. audit: id, user_id, file_id, action, detail, at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.core import col, lookup

COUNTS = "map<string,double>"


def counts_of(text: Column | str) -> Column:
    """Counts kept as JSON; what cannot be read, and values that are no numbers, count as nothing."""
    return F.map_filter(F.coalesce(F.from_json(col(text), COUNTS), F.create_map().cast(COUNTS)), lambda k, v: v.isNotNull())


def done(files: DataFrame) -> DataFrame:
    return files.where(F.col("status") == "DONE")


def distribution(files: DataFrame, column: str = "pii_summary") -> DataFrame:
    """Totals by key over finished files, largest first; ties by key."""
    rows = done(files).select(F.explode(counts_of(column)).alias("name", "n"))
    return rows.groupBy("name").agg(F.sum("n").cast("bigint").alias("value")).orderBy(F.desc("value"), "name")


def top_files(files: DataFrame, n: int = 12) -> DataFrame:
    return done(files).where("total_pii > 0").orderBy(F.desc("total_pii"), "id").limit(n).select("name", F.col("total_pii").alias("total"))


def dashboard(files: DataFrame, users: DataFrame) -> DataFrame:
    """All figures of the front page: one pass over files, one over users."""
    f = files.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "DONE").alias("done"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.coalesce(F.sum("total_pii"), F.lit(0)).alias("total_pii"))
    return f.crossJoin(users.agg(F.count("*").alias("users")))  # one row each


def with_uploader(files: DataFrame, users: DataFrame) -> DataFrame:
    own = users.select(F.col("id").alias("uploaded_by"), F.col("name").alias("uploader"), F.col("email").alias("uploader_email"), F.col("role").alias("uploader_role"))
    return files.join(own, "uploaded_by")


def recent_files(files: DataFrame, users: DataFrame, n: int = 8) -> DataFrame:
    return with_uploader(files.orderBy(F.desc("uploaded_at"), "id").limit(n), users).orderBy(F.desc("uploaded_at"), "id")


SORTS: dict[str, tuple] = {
    "newest": (F.desc_nulls_first, "processed_at"), "oldest": (F.asc_nulls_last, "processed_at"), "pii-desc": (F.desc_nulls_first, "total_pii"),
    "pii-asc": (F.asc_nulls_last, "total_pii"), "name-az": (F.asc, "name"), "name-za": (F.desc, "name"),
}
DAYS = {"7d": 7, "30d": 30, "90d": 90, "1y": 365}
RANGES = {"none": "total_pii = 0", "low": "total_pii BETWEEN 1 AND 10", "medium": "total_pii BETWEEN 11 AND 50", "high": "total_pii >= 51"}


def search(files: DataFrame, text: str = "", kind: str = "all", since: str | None = None, pii: str | None = None, sort: str = "newest", now=None) -> DataFrame:
    """Finished files by name, type, age and amount, in one of six orders; unknown choices have no effect, an unknown order is the newest."""
    out = done(files)
    if text.strip():
        out = out.where(F.contains(F.lower("name"), F.lit(text.strip().lower())))
    if kind == "image":
        out = out.where(F.col("file_type").isin(*fixed.IMAGES))
    elif kind != "all":
        out = out.where(F.col("file_type") == kind)
    if since in DAYS:
        out = out.where(F.col("processed_at") >= (F.lit(now) if now is not None else F.current_timestamp()) - F.make_interval(days=F.lit(DAYS[since])))
    if pii in RANGES:
        out = out.where(RANGES[pii])
    order, by = SORTS.get(sort, SORTS["newest"])
    return out.orderBy(order(by), "id")


def page(df: DataFrame, number: int = 1, size: int = 10, most: int = 200) -> DataFrame:
    """A page of an ordered result; sizes are kept within 1 and `most`."""
    size = max(1, min(size, most))
    return df.offset((max(1, number) - 1) * size).limit(size)


def page_info(df: DataFrame, number: int = 1, size: int = 10) -> DataFrame:
    """Rows in all, and whether there are more."""
    return df.agg(F.count("*").alias("total")).withColumn("has_more", F.lit(number * size) < F.col("total"))


def admin_search(files: DataFrame, users: DataFrame, text: str) -> DataFrame:
    q = F.lit(text.strip().lower())
    return with_uploader(files, users).where(F.contains(F.lower("name"), q) | F.contains(F.lower("uploader"), q))


def audit_trail(audit: DataFrame, users: DataFrame, files: DataFrame, action: str | None = None) -> DataFrame:
    """Audit rows with their user, and their file if it is still there, latest first."""
    rows = audit.where(F.col("action") == action) if action else audit
    u, f = users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email")), files.select(F.col("id").alias("file_id"), F.col("name").alias("file_name"))
    return rows.join(u, "user_id").join(f, "file_id", "left").orderBy(F.desc("at"), "id")


def user_file_counts(users: DataFrame, files: DataFrame) -> DataFrame:
    n = files.groupBy(F.col("uploaded_by").alias("id")).agg(F.count("*").alias("files"))
    return users.join(n, "id", "left").fillna(0, ["files"])


def viewer_rollup(files: DataFrame) -> DataFrame:
    """Totals by the viewer's types."""
    rows = done(files).select(F.explode(counts_of("pii_summary")).alias("name", "n"))
    return rows.groupBy(lookup(F.col("name"), fixed.VIEWER_TYPES, F.lit("NAME")).alias("viewer_type")).agg(F.sum("n").cast("bigint").alias("n"))


def layers_of(counts: Column) -> Column:
    """Counts of the three layers, by either naming."""
    either = lambda *names: F.coalesce(*[counts[n] for n in names], F.lit(0.0)).cast("bigint")
    return F.struct(either("regex").alias("regex"), either("spacy", "presidio_spacy").alias("spacy"), either("bert", "indic_bert").alias("bert"))


def types_seen(entities: DataFrame, order: str = "ord") -> DataFrame:
    """Types with their counts, by first appearance."""
    return entities.groupBy("entity_type").agg(F.min(order).alias("first"), F.count("*").alias("n")).orderBy("first")


def for_role(files: DataFrame, role: str) -> DataFrame:
    """What a role may see: users get neither content nor summaries, and finished files alone."""
    if role == "ADMIN":
        return files
    hidden = [c for c in ("content", "sanitized_content", "pii_summary", "layer_breakdown") if c in files.columns]
    return done(files).drop(*hidden)


def download(files: DataFrame, sanitized: bool = True, role: str = "USER") -> DataFrame:
    """id, file name with its suffix, and MIME type; originals are for administrators."""
    own = files if sanitized or role == "ADMIN" else files.where(F.lit(False))
    name = F.concat(F.regexp_replace("name", r"\.[^.]+$", ""), F.lit("_sanitized" if sanitized else "_original"), F.lit("."), F.col("file_type"))
    return own.select("id", name.alias("file_name"), lookup(F.col("file_type"), fixed.MIME_TYPES, F.lit("application/octet-stream")).alias("mime_type"))


def accepted(uploads: DataFrame, name: str = "name", size: str = "size") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): known extensions, and no more than the upload limit."""
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    reason = F.when(~kind.isin(*fixed.UPLOAD_TYPES), "type").when(F.col(size) > fixed.UPLOAD_BYTES, "size")
    judged = uploads.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def looked_up(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(id), each id once, with the file of that id, and whether there is one."""
    ids = wanted.select("id").where("id IS NOT NULL").distinct()
    return ids.join(files.withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def insert_files(files: DataFrame, new: DataFrame) -> DataFrame:
    return files.unionByName(new.withColumn("status", F.lit("PROCESSING")), allowMissingColumns=True)


def update_results(files: DataFrame, results: DataFrame) -> DataFrame:
    """Files with the results of processing; those in results are DONE, or FAILED where `error` is set."""
    fresh = [c for c in results.columns if c in files.columns and c != "id"]
    new = results.select("id", *[F.col(c).alias(f"_{c}") for c in fresh], F.lit(True).alias("_hit"), (F.col("error") if "error" in results.columns else F.lit(None)).alias("_error"))
    out = files.join(new, "id", "left")
    status = F.when(F.col("_error").isNotNull(), "FAILED").when(F.col("_hit"), "DONE").otherwise(F.col("status"))
    return out.select(*[status.alias(c) if c == "status" else F.coalesce(f"_{c}", c).alias(c) if c in fresh else F.col(c) for c in files.columns])


def delete_files(files: DataFrame, audit: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files without those in gone(id), and audit rows that no longer name them."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    left = files.join(ids, F.col("id") == F.col("_gone"), "left_anti")
    rows = audit.join(ids, F.col("file_id") == F.col("_gone"), "left").withColumn("file_id", F.when(F.col("_gone").isNull(), F.col("file_id"))).drop("_gone")
    return left, rows


def delete_users(users: DataFrame, files: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users without those in gone(id), and without their files."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    return users.join(ids, F.col("id") == F.col("_gone"), "left_anti"), files.join(ids, F.col("uploaded_by") == F.col("_gone"), "left_anti")
