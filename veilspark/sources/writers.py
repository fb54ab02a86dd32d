"""Writers: texts, tables in row order, JSON, report files, paragraphs and redaction boxes."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators import jsontext
from veilspark.operators.structured import json_indent
from veilspark.sources.ordered import OrderedFile
from veilspark.sources.readers import W


def joined_chunks(chunks: DataFrame, *keys: str, idx: str = "chunk_idx", text: str = "text") -> DataFrame:
    """Masked chunks put together in their order."""
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(idx), F.col(text).alias("t")))), lambda x: x["t"]), "").alias("text"))


def write_texts(docs: DataFrame, path: str, text: str = "text") -> None:
    docs.select(text).write.mode("overwrite").text(path)


def write_ordered(df: DataFrame, path: str, index: str = "row_idx", kind: str = "csv", single: bool = True) -> None:
    """Rows in the order of `index`, which is not written, as one file with its header once; see `ordered.OrderedFile` for what `single` does."""
    df.sparkSession.dataSource.register(OrderedFile)
    df.orderBy(index).drop(index).write.format(OrderedFile.name()).option("kind", kind).option("single", str(single).lower()).mode("overwrite").save(path)


def write_csv(df: DataFrame, path: str, index: str = "row_idx") -> None:
    """One CSV file, rows in order, header once; nulls are empty cells."""
    write_ordered(df.select(index, *[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c != index]), path, index)


def json_like(text: Column | str, original: Column | str) -> Column:
    """JSON written as the original is: with two spaces of indent if its head is indented, else on one line. Null where the text is not JSON."""
    return F.when(json_indent(original) == 2, jsontext.written(text, 2)).otherwise(jsontext.written(text))


def json_text(value: Column, indent: bool = False) -> Column:
    return F.to_json(value, {"pretty": "true"} if indent else {})


def pii_report(entities: DataFrame) -> DataFrame:
    """Rows of the report: line is 1 throughout, confidence has two places."""
    return entities.select(F.lit(1).alias("Line"), F.col("entity_type").alias("Entity Type"), F.col("original").alias("Original Value"), F.col("masked").alias("Masked Value"), F.format_string("%.2f", "confidence").alias("Confidence"), F.col("layer").alias("Layer"))


def pii_report_json_column() -> Column:
    """A line of the report as JSON, of the eight columns by these names."""
    return F.to_json(F.struct("id", "entity_type", "original", "masked", "start", "end", "confidence", "layer"))


def pii_report_json(entities: DataFrame) -> DataFrame:
    return entities.select(pii_report_json_column().alias("json"))


def redaction_boxes(values: DataFrame, words: DataFrame, page: str = "page_idx") -> DataFrame:
    """Boxes to black out: every place of each distinct value on its page."""
    from veilspark.operators.ocr import boxes

    return boxes(values.dropDuplicates([page, "value"]), words, page)


def scrubbed(names: list[str], blank: bool = False) -> dict[str, Column]:
    """What document properties become."""
    return {n: F.lit("" if blank else "Sanitized") for n in names}


def rewrite_docx(content: bytes, runs: dict[tuple[str, int], list[str]]) -> bytes:
    """The document with new texts for the runs of given (part, paragraph), and its core properties scrubbed."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in old.infolist():
            data = old.read(item)
            if any(part == item.filename for part, _ in runs):
                root = ElementTree.fromstring(data)
                for i, p in enumerate(root.iter(f"{W}p")):
                    for r, text in zip(p.iter(f"{W}r"), runs.get((item.filename, i), []), strict=False):
                        for k, t in enumerate(r.iter(f"{W}t")):
                            t.text = text if k == 0 else ""
                data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            elif item.filename == "docProps/core.xml":
                root = ElementTree.fromstring(data)
                for x in root:
                    if not x.tag.endswith(("created", "modified")):
                        x.text = "Sanitized"
                data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            new.writestr(item, data)
    return out.getvalue()
