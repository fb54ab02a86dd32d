"""JSON, SQL scripts and paragraphs made of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.core import col, let
from veilspark.operators import jsontext
from veilspark.operators.chunking import sql_statements
from veilspark.operators.detect import pattern_spans
from veilspark.operators.masking import replace_all, replace_many, replace_values, value_map
from veilspark.operators.resolve import dedup_same_type


def json_root(text: Column | str) -> Column:
    """array, object or scalar, by the first sign."""
    head = F.regexp_extract(col(text), r"^\s*(.)", 1)
    return F.when(head == "[", "array").when(head == "{", "object").otherwise("scalar")


def json_indent(text: Column | str) -> Column:
    """2 if the head of the text is indented."""
    return F.when(F.left(col(text), F.lit(512)).rlike("\n(?:  |\t)"), 2)


def json_items(text: Column | str) -> Column:
    """Elements of a JSON array, each as JSON text: texts keep their quotes, the keys of objects their order; numbers are written in
    their shortest form."""
    t = col(text)
    plain, typed = F.from_json(t, T.ArrayType(T.StringType())), F.from_json(t, "array<variant>")
    return F.zip_with(plain, typed, lambda p, v: F.when(p.isNull(), "null").when(F.schema_of_variant(v) == "STRING", F.to_json(v)).otherwise(p))


def json_merge(parts: Column) -> Column:
    """Arrays of JSON texts put together again as one JSON array."""
    return F.concat(F.lit("["), F.array_join(F.flatten(parts), ","), F.lit("]"))


def json_update(parts: Column) -> Column:
    """JSON objects put together as one: a key stands where it came first, with its last value."""
    read = lambda x: F.from_json(x, "map<string,variant>")
    none = F.create_map().cast("map<string,variant>")
    return F.to_json(F.aggregate(parts, none, lambda acc, x: F.map_zip_with(acc, F.coalesce(read(x), none), lambda _, a, b: F.coalesce(b, a))))


def mask_leaves(value: Column, kind: T.DataType, mask) -> Column:
    """mask() over every string leaf of a typed column; keys and numbers stay. The recursion is over the schema, at plan time."""
    if isinstance(kind, T.StringType):
        return mask(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: mask_leaves(x, kind.elementType, mask))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: mask_leaves(v, kind.valueType, mask))
    if isinstance(kind, T.StructType):
        made = F.struct(*[mask_leaves(value[f.name], f.dataType, mask).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), made)
    return value


def mask_json_text(text: Column | str, entries: Column, indent: int | None = None) -> Column:
    """Value replacements, one after another, in the string leaves of JSON of any shape; keys, numbers and the order of both stay. Null where the text is not JSON."""
    return jsontext.rewritten(text, lambda values: F.transform(values, lambda v: replace_values(v, entries)), indent)


def mask_json_values(docs: DataFrame, text: str, entries: str, indent: int | None = None) -> DataFrame:
    """docs with masked_json: the same for entries that may be many, which are replaced in one pass over all leaves of a text."""
    out = docs.withColumn("_found", jsontext.leaves(text, blank=True)).withColumn("_values", replace_many(F.col("_found.value"), F.col(entries)))
    return out.withColumn("masked_json", jsontext.rewritten(text, F.col("_values"), indent)).drop("_found", "_values")


def sanitize_json(docs: DataFrame, text: str = "text", mode: str = "redact", indent: int | None = None, spans_of=None) -> DataFrame:
    """docs with masked_json, and leaves (path, leaf_idx, value, spans): each string leaf is a text of its own to detect in, blank ones are not.

    spans_of(column) gives a text's spans, by default those of the patterns, resolved within each type. Where a text is not JSON both are null.
    """
    spans_of = spans_of or (lambda value: dedup_same_type(pattern_spans(value)))
    none = spans_of(F.lit(""))
    judged = F.transform(jsontext.leaves(text, blank=True), lambda x: F.struct(x["path"].alias("path"), x["leaf_idx"].alias("leaf_idx"), x["value"].alias("value"), F.when(x["value"].rlike(jsontext.BLANK), none).otherwise(spans_of(x["value"])).alias("spans")))
    out = docs.withColumn("_leaves", judged)
    made = F.transform("_leaves", lambda x: F.when(F.size(x["spans"]) > 0, replace_values(x["value"], value_map(x["spans"], mode))).otherwise(x["value"]))
    masked = jsontext.rewritten(text, made, indent)
    return out.withColumn("masked_json", masked).withColumn("leaves", F.filter("_leaves", lambda x: ~x["value"].rlike(jsontext.BLANK))).drop("_leaves")


def json_leaves(text: Column | str, paths: dict[str, str]) -> Column:
    """Array of (path, value) for given JSON paths, blank ones left out."""
    every = F.array(*[F.struct(F.lit(name).alias("path"), F.get_json_object(col(text), path).alias("value")) for name, path in paths.items()])
    return F.filter(every, lambda x: F.trim(F.coalesce(x["value"], F.lit(""))) != "")


def mask_sql(text: Column | str, entries: Column, joiner: str = "\n") -> Column:
    """Statements masked by value and joined again."""
    return F.array_join(replace_many(sql_statements(text), entries), joiner)


def mask_runs(runs: Column, entries: Column) -> Column:
    """Runs of a paragraph: each is masked on its own, then across them; what only shows across runs moves into the first one."""
    own = replace_many(runs, entries, "as given")
    both = F.struct(own.alias("own"), replace_all(F.array_join(own, ""), entries).alias("joined"))
    across = lambda x: F.when(x["joined"] != F.array_join(x["own"], ""), F.transform(x["own"], lambda r, i: F.when(i == 0, x["joined"]).otherwise(""))).otherwise(x["own"])
    return let(both, across)
