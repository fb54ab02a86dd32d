"""Words that text recognisers have found in images, as tables: merging of two engines, boxes for values, and counts per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = ("text", "confidence", "x", "y", "width", "height", "engine")


def confident(words: DataFrame, least: float) -> DataFrame:
    return words.where((F.col("confidence") > least) & (F.trim("text") != ""))


def _ends(words: DataFrame, p: str) -> DataFrame:
    return words.select(*[F.col(c).alias(f"{p}{c}") for c in words.columns])


def merge_words(first: DataFrame, second: DataFrame, image: str = "img_id") -> DataFrame:
    """Words of both engines; where boxes overlap by over half of the smaller one, the surer word stays.

    A word of the second engine that beats k words of the first stands k times, as each of them is replaced.
    """
    a, b = _ends(first, "a_"), _ends(second, "b_")
    wide = F.greatest(F.lit(0), F.least(F.expr("a_x + a_width"), F.expr("b_x + b_width")) - F.greatest("a_x", "b_x"))
    high = F.greatest(F.lit(0), F.least(F.expr("a_y + a_height"), F.expr("b_y + b_height")) - F.greatest("a_y", "b_y"))
    area = lambda p: F.greatest(F.lit(1), F.col(f"{p}_width") * F.col(f"{p}_height"))
    same = (F.col(f"a_{image}") == F.col(f"b_{image}")) & (wide * high > 0) & (wide * high / F.least(area("a"), area("b")) > 0.5)
    beats = F.col("b_confidence") > F.col("a_confidence")
    kept = a.join(b, same & beats, "left_anti").select(*[F.col(f"a_{c}").alias(c) for c in first.columns])
    alone = b.join(a, same, "left_anti").select(*[F.col(f"b_{c}").alias(c) for c in second.columns])
    better = b.join(a, same & beats).select(*[F.col(f"b_{c}").alias(c) for c in second.columns])
    return kept.unionByName(alone).unionByName(better)


def reading_order(words: DataFrame, *keys: str) -> DataFrame:
    """From the top, then from the left; equal places by text."""
    return words.orderBy(*keys, "y", "x", "text")


def reading_text(words: DataFrame, image: str = "img_id") -> DataFrame:
    """Per image its words in reading order (from the top, then from the left; equal places by text), and how many they are."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "text"))), lambda w: w["text"])
    return words.groupBy(image).agg(F.array_join(ordered, " ").alias("text"), F.count("*").alias("words"))


def boxes(values: DataFrame, words: DataFrame, image: str = "img_id", dx: str | None = None, dy: str | None = None) -> DataFrame:
    """Boxes of the words whose text holds a value or lies in it, in any case; tile offsets are added where given."""
    a, b = F.lower("value"), F.lower("text")
    hit = values.join(words.where(F.col("text") != ""), image).where(F.contains(a, b) | F.contains(b, a))
    x, y = F.col("x") + (F.col(dx) if dx else 0), F.col("y") + (F.col(dy) if dy else 0)
    return hit.select(image, "value", x.alias("x0"), y.alias("y0"), (x + F.col("width")).alias("x1"), (y + F.col("height")).alias("y1"))


def tile_dedup(detections: DataFrame, image: str = "img_id") -> DataFrame:
    """One row per type and value of an image, however many tiles have it."""
    return detections.groupBy(image, "entity_type", "value").agg(F.count("*").alias("tiles"))


def dominant_engine(words: DataFrame, image: str = "img_id") -> DataFrame:
    return words.groupBy(image).agg(F.mode("engine", True).alias("engine"))


def exif_hits(exif: Column, spans: Column) -> Column:
    """How many spans' values the image's own text fields hold."""
    return F.size(F.filter(spans, lambda s: F.contains(exif, s["value"])))


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as decimal degrees, six places."""
    value = d + m / 60 + s / 3600
    return F.format_string("%.6f", F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value))


EXIF_FIELDS = ("Make", "Model", "DateTime", "DateTimeOriginal", "Artist", "Copyright", "ImageDescription", "UserComment", "Software")


def exif_text(lat: Column, lon: Column, fields: Column) -> Column:
    """The text fields of an image: its place, then the named fields that are not empty."""
    place = F.when(lat.isNotNull() & lon.isNotNull(), F.concat(F.lit("GPS: "), lat, F.lit(", "), lon))
    named = [F.when(F.trim(F.coalesce(fields[f], F.lit(""))) != "", F.concat(F.lit(f"{f}: "), F.trim(fields[f]))) for f in EXIF_FIELDS]
    return F.concat_ws("\n", place, *named)
