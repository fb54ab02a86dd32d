"""Readers: whole texts, tables of strings, JSON, documents of paragraphs, page texts, and relational tables."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.text import decoded

KIND = r"\.([^./]+)$"


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, file_type, size, content."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.lower(F.regexp_extract("path", KIND, 1)).alias("file_type"), F.col("length").alias("size"), "content")


def text_files(spark: SparkSession, path: str, pattern: str = "*.{txt,md,sql,json}") -> DataFrame:
    """Whole texts; bytes that are not UTF-8 become U+FFFD."""
    return binary_files(spark, path, pattern).withColumn("text", decoded("content")).drop("content")


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, nothing inferred, empty cells as empty texts."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', nullValue="\0", emptyValue="")
    return df.fillna("")


NULL_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def csv_files_blanked(spark: SparkSession, path: str) -> DataFrame:
    """The same, words that stand for a missing value made empty."""
    df = csv_files(spark, path)
    return df.select(*[F.when(F.col(f"`{c}`").isin(*NULL_WORDS), "").otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON texts, with a VARIANT beside them (null where they do not parse)."""
    return text_files(spark, path, "*.json").withColumn("node", F.try_parse_json("text"))


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def paragraphs_of(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(part, number, runs) of body, table, header and footer paragraphs of a document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = ["word/document.xml", *sorted(n for n in z.namelist() if n.startswith(("word/header", "word/footer")) and n.endswith(".xml"))]
        for name in names:
            for i, p in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{W}p")):
                yield name, i, ["".join(t.text or "" for t in r.iter(f"{W}t")) for r in p.iter(f"{W}r")]


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """files(path, content) as rows path, part, para_idx, runs; a file that is no document gives none."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, part, i, runs) for part, i, runs in paragraphs_of(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())), strict=True)], names=["path", "part", "para_idx", "runs"])

    return files.select("path", "content").mapInArrow(run, "path string, part string, para_idx int, runs array<string>")


def _decoded(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def _json(content: bytes) -> str:
    text = _decoded(content)
    json.loads(text)
    return text


def _docx(content: bytes) -> str:
    return "\n".join("".join(runs) for _, _, runs in paragraphs_of(content))


#: How the text of a file is had, by its type. Types that need outside libraries are added by the caller.
EXTRACTORS = {"txt": _decoded, "md": _decoded, "sql": _decoded, "csv": _decoded, "json": _json, "docx": _docx}


def extracted_text(files: DataFrame, extractors: dict, attempts: int = 1) -> DataFrame:
    """files(file_type, content) with text and _error: what an extractor raises is caught with its file, and tried again by itself."""

    def run(kinds: pa.Array, contents: pa.Array) -> pa.Array:
        out = []
        for kind, content in zip(kinds.to_pylist(), contents.to_pylist(), strict=True):
            own = extractors.get((kind or "").lower().lstrip("."))
            text, error = None, None
            if own is None:
                error = "unknown file type"
            elif content is None:
                error = "no content"
            else:
                for _ in range(attempts):
                    try:
                        text, error = own(content), None
                        break
                    except Exception as e:  # whatever a reader of one file raises is that file's error
                        error = f"{type(e).__name__}: {e}"
            out.append({"text": text, "error": error})
        return pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))

    found = files.withColumn("_found", F.arrow_udf(run, "struct<text:string,error:string>")("file_type", "content"))
    return found.withColumn("text", F.col("_found.text")).withColumn("_error", F.col("_found.error")).drop("_found")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """`csv_files` for files that may be empty or hold a header alone, which give no rows; no file at all, or none with a header, gives no columns."""
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path")
    # Paths of a table's files are few, and are what a read is told anyway.
    full = sorted(r.path for r in sizes.collect())
    return csv_files(spark, full) if full else spark.createDataFrame([], "")


def image_sizes(files: DataFrame) -> DataFrame:
    """files(content) with width, height and size_error, from the first bytes of PNG and JPEG files: no pixel is decoded.

    What is of another kind, empty, or cut off before its size has nulls and says so.
    """

    def run(contents: pa.Array) -> pa.Array:
        out = []
        for content in contents.to_pylist():
            size = image_size(content or b"")
            out.append({"width": size and size[0], "height": size and size[1], "error": None if size else "no PNG or JPEG header with a size"})
        return pa.array(out, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("error", pa.string())]))

    found = files.withColumn("_size", F.arrow_udf(run, "struct<width:int,height:int,error:string>")("content"))
    return found.withColumn("width", F.col("_size.width")).withColumn("height", F.col("_size.height")).withColumn("size_error", F.col("_size.error")).drop("_size")


def image_size(head: bytes) -> tuple[int, int] | None:
    """(width, height): a PNG's first chunk has them; a JPEG's stand in its frame header, which is found by going from segment to segment."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 24:
        return int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big")
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(head) and head[at] == 0xFF:
        kind, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return (int.from_bytes(head[at + 7 : at + 9], "big"), int.from_bytes(head[at + 5 : at + 7], "big")) if at + 9 <= len(head) else None
        else:
            at += 2 + size
    return None


def extracted(files: DataFrame, extract, schema: str) -> DataFrame:
    """Pages, words or tags that an outside library finds: extract(content) yields tuples for `schema`, beside the path.

    Page texts of PDF files, recognised words of images and their text fields come through here; the libraries are not part of this one.
    """

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = [(path, *x) for path, content in zip(frame["path"], frame["content"], strict=True) for x in extract(content)]
            yield pd.DataFrame(rows, columns=["path", *[c.split()[0] for c in schema.split(", ")]])

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def from_text(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


#: The words that generated people are put together from.
FIRST = ["Aarav", "Diya", "Ishaan", "Kavya", "Rohan", "Meera", "Arjun", "Ananya"]
LAST = ["Sharma", "Patel", "Reddy", "Nair", "Gupta", "Singh", "Iyer"]
CITIES = ["Mumbai", "Delhi", "Bengaluru", "Chennai", "Kolkata"]
STATES = ["Maharashtra", "Delhi", "Karnataka", "Tamil Nadu", "West Bengal"]
STREETS = ["MG Road", "Park Street", "Ring Road"]


def people_of(rows: DataFrame, key: str) -> DataFrame:
    """A made-up record with personal data in every column for each row, a function of its whole-number key alone."""
    k = F.col(f"`{key}`").cast("bigint")
    pick = lambda words, step: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.floor(k / step), F.lit(len(words))) + 1).cast("int"))
    pad = lambda x, w: F.lpad(F.pmod(x, F.lit(10**w)).cast("string"), w, "0")
    letter = lambda x: F.chr((65 + F.pmod(x, F.lit(26))).cast("int"))
    phone = lambda step: F.concat(F.lit("+91"), (6000000000 + F.pmod(k * step, F.lit(3999999999))).cast("string"))
    return rows.select(
        k.cast("string").alias("id"), F.concat_ws(" ", pick(FIRST, 1), pick(LAST, 8)).alias("full_name"), F.concat(F.lit("user"), k.cast("string"), F.lit("@mail.example.com")).alias("email"), phone(7919).alias("phone"), phone(104729).alias("alt_phone"),
        F.concat_ws(" ", (2000 + F.pmod(k, F.lit(8000))).cast("string"), pad(k * 7, 4), pad(k * 13, 4)).alias("aadhaar"), F.concat(F.lit("ABC"), letter(k), letter(k * 3), pad(k, 4), letter(k * 5)).alias("pan"),
        F.concat(pad(k % 28 + 1, 2), F.lit("/"), pad(k % 12 + 1, 2), F.lit("/"), (1950 + k % 50).cast("string")).alias("dob"), F.element_at(F.array(F.lit("F"), F.lit("M")), (k % 2 + 1).cast("int")).alias("gender"),
        F.concat((k % 200 + 1).cast("string"), F.lit(" "), pick(STREETS, 3)).alias("address"), pick(CITIES, 1).alias("city"), pick(STATES, 1).alias("state"), (100000 + F.pmod(k * 37, F.lit(899999))).cast("string").alias("pincode"),
        (100000000000 + k * 104729).cast("string").alias("account_number"), F.concat(F.lit("SBIN0"), pad(k, 6)).alias("ifsc"),
    )


def people(spark: SparkSession, n: int) -> DataFrame:
    """n such records, numbered from 0."""
    return people_of(spark.range(n), "id")
