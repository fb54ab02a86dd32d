"""Cutting texts, statements, rows and images into chunks, with context from the neighbours.

A text's chunks are an array in its row, so nothing is shuffled; rows of a table are numbered from one count per partition.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.functions import fixed
from veilspark.functions.core import col, empty, let, strip


def size_mb(length: Column | str) -> Column:
    return col(length) / (1024 * 1024)


def needs_chunking(length: Column | str) -> Column:
    return size_mb(length) > fixed.CHUNK_MB


def valid_size(length: Column | str) -> Column:
    return size_mb(length) <= fixed.ENGINE_MB


def groups_of(items: Column, n: int) -> Column:
    """An array cut into arrays of n."""
    return F.when(F.size(items) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / n).cast("int")), lambda i: F.slice(items, i * n + 1, n)))


def settled(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read again, so that all that reads it sees the same rows. The files go when the session ends."""
    spark, folder = df.sparkSession, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    path = f"{(folder or 'file://' + tempfile.mkdtemp(prefix='veilspark-')).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Rows numbered from 0 in the order of the input: a number within the partition plus one offset per partition.

    Only the count of each partition is shuffled and sent to all tasks, never the rows. The rows are written with their places first: what a
    shuffle has made may be cut into other partitions when it is worked out again.
    """
    marked = settled(df.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).alias("_p")
    counts = marked.groupBy(part).agg(F.count("*").alias("_n")).collect()
    offsets, at = {}, 0
    for p, n in sorted(counts):
        offsets[p], at = at, at + n
    table = df.sparkSession.createDataFrame([(p, o) for p, o in offsets.items()] or [(0, 0)], "_q long, _o long")
    return marked.join(F.broadcast(table), F.shiftright("_m", 33) == F.col("_q")).withColumn(name, F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_q", "_o")


def chunk_of(index: Column | str, n: int) -> Column:
    return F.floor(col(index) / n)


def head_sample(index: Column | str, n: int, rows: int = fixed.SAMPLE_ROWS) -> Column:
    """Whether a row is among the first `rows` of its chunk of n; no window is needed."""
    return col(index) % n < rows


PACKED = "struct<chunks:array<string>,current:string>"


def _packed(pieces: Column, n: int, text: Column) -> Column:
    zero = F.struct(empty("string").alias("chunks"), F.lit("").alias("current"))

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["current"]) + p["need"] > n) & (acc["current"] != "")
        return F.struct(F.when(full, F.concat(acc["chunks"], F.array(acc["current"]))).otherwise(acc["chunks"]).alias("chunks"), F.when(full, p["text"]).otherwise(F.concat(acc["current"], p["text"])).alias("current"))

    def last(acc: Column) -> Column:
        out = F.when(acc["current"] != "", F.concat(acc["chunks"], F.array(acc["current"]))).otherwise(acc["chunks"])
        return F.when(F.size(out) == 0, F.array(text)).otherwise(out)

    return F.aggregate(pieces, zero, step, last)


PARAGRAPHS = r"(?<!\n)(?=\n\n)|(?<=\n\n)(?=[^\n])"


def pack_paragraphs(text: Column | str, n: int, sentences: bool = True) -> Column:
    """Paragraphs gathered up to about n code points; a longer paragraph is cut after ". " where sentences is set."""
    t = col(text)
    parts = F.split(t, PARAGRAPHS, -1)
    whole = lambda p: F.array(F.struct(p.alias("text"), F.length(p).alias("need")))
    cut = lambda p: F.transform(F.split(p, r"(?<=\. )", -1), lambda s, i: F.struct(s.alias("text"), F.when(i == 0, F.length(p)).otherwise(F.length(s)).alias("need")))
    pieces = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > n, cut(p)).otherwise(whole(p)) if sentences else whole(p)))
    return _packed(pieces, n, t)


def fixed_width(text: Column | str, n: int) -> Column:
    t = col(text)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(t) - 1) / n).cast("int"))), lambda i: F.substring(t, i * n + 1, F.lit(n)))


#: Statements up to their semicolon; quoted text and comments may hold semicolons.
STATEMENT = r"""(?s)(?:[^;'"/\-]++|'(?:[^']++|'')*+'|"[^"]*+"|--[^\n]*+|/\*.*?\*/|['"/\-])++;?+|;"""


def sql_statements(text: Column | str, aware: bool = True) -> Column:
    """Statements, stripped, without empty ones; the plain variant cuts at every semicolon."""
    t = col(text)
    raw = F.regexp_extract_all(t, F.lit(STATEMENT), F.lit(0)) if aware else F.split(t, "(?<=;)", -1)
    return F.filter(F.transform(raw, lambda s: strip(s)), lambda s: s != "")


def with_context(chunks: Column, n: int = fixed.TEXT_OVERLAP) -> Column:
    """Array of (idx, before, text, after): each chunk with up to n code points of its neighbours."""
    near = lambda own: F.transform(own, lambda c, i: F.struct(i.alias("idx"), F.coalesce(F.right(F.get(own, i - 1), F.lit(n)), F.lit("")).alias("before"), c.alias("text"), F.coalesce(F.left(F.get(own, i + 1), F.lit(n)), F.lit("")).alias("after")))
    return let(chunks, near)


def neighbours(df: DataFrame, text: str, order: str, *keys: str, n: int = fixed.TEXT_OVERLAP) -> DataFrame:
    """The same for chunks that are rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("before", F.coalesce(F.right(F.lag(text).over(w), F.lit(n)), F.lit(""))).withColumn("after", F.coalesce(F.left(F.lead(text).over(w), F.lit(n)), F.lit("")))


def statement_context(statements: Column, n: int, overlap: int = fixed.STATEMENT_OVERLAP) -> Column:
    """Array of (idx, before, statements, after): groups of n statements with those around them."""

    def grouped(own: Column) -> Column:
        groups = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(own) - 1) / n).cast("int")))
        return F.transform(groups, lambda i: F.struct(i.alias("idx"), F.slice(own, F.greatest(F.lit(1), i * n + 1 - overlap), F.least(F.lit(overlap), i * n)).alias("before"), F.slice(own, i * n + 1, F.lit(n)).alias("statements"), F.slice(own, (i + 1) * n + 1, F.lit(overlap)).alias("after")))

    return let(statements, grouped)


def tiles(images: DataFrame, width: str = "w", height: str = "h", overlap: int = fixed.TILE_OVERLAP) -> DataFrame:
    """A 4 by 4 grid per image, each tile widened by the overlap; the last row and column take the rest. Tiny images are one tile."""
    g, w, h = fixed.GRID, F.col(width), F.col(height)
    tw, th = F.floor(w / g), F.floor(h / g)
    single = (tw == 0) | (th == 0)
    cells = F.when(single, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(g * g - 1)))
    out = images.withColumn("tile_idx", F.explode(cells)).withColumn("tile_row", F.floor(F.col("tile_idx") / g).cast("int")).withColumn("tile_col", F.col("tile_idx") % g)
    left, top = F.col("tile_col") * tw, F.col("tile_row") * th
    right = F.when(single | (F.col("tile_col") == g - 1), w).otherwise(left + tw)
    bottom = F.when(single | (F.col("tile_row") == g - 1), h).otherwise(top + th)
    core = {"core_left": left, "core_top": top, "core_right": right, "core_bottom": bottom}
    crop = {"x_start": F.greatest(F.lit(0), left - overlap), "y_start": F.greatest(F.lit(0), top - overlap), "x_end": F.least(w, right + overlap), "y_end": F.least(h, bottom + overlap)}
    return out.select(*images.columns, "tile_idx", "tile_row", "tile_col", *[x.cast("int").alias(k) for k, x in (core | crop).items()])


def small_image(width: Column, height: Column) -> Column:
    """Whether an image is handled as one tile."""
    return (width < fixed.SMALL_IMAGE) & (height < fixed.SMALL_IMAGE)


def file_id(stem: Column | str) -> Column:
    s = col(stem)
    return F.when(s.rlike("^[0-9a-fA-F]{32}"), F.left(s, F.lit(32))).otherwise(F.uuid())


def integrity(original: Column | str, merged: Column | str) -> Column:
    """Counts that must survive chunking: lines, paragraphs and semicolons of both sides, and whether they agree."""
    count = lambda t, x: F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))
    # Each side is worked out once, and each count of it.
    counts = lambda x: F.struct(*[count(x[side], sign).alias(f"{side}{name}") for name, sign in (("lines", "\n"), ("semicolons", ";")) for side in ("a", "b")])
    sides = F.struct(col(original).alias("a"), col(merged).alias("b"))
    return let(let(sides, counts), lambda n: F.struct(n["alines"].alias("lines"), n["blines"].alias("merged_lines"), n["asemicolons"].alias("semicolons"), n["bsemicolons"].alias("merged_semicolons"), ((n["alines"] == n["blines"]) & (n["asemicolons"] == n["bsemicolons"])).alias("intact")))
