"""The two detection profiles, composed at plan time from the operators.

gated: layers chosen by a plan, spans of one type resolved, values masked wherever they occur, no threshold by default.
contextual: normalised text, context rules, spans of any type resolved, sure and likely spans masked by position.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.core import SPAN, empty, let
from veilspark.functions.text import clean
from veilspark.operators import chunking, context, detect, masking, resolve, summary
from veilspark.plans.config import Plan
from veilspark.sources import readers


@dataclass
class Providers:
    """Name recognisers; by default there are none."""

    spacy: detect.NameProvider = detect.no_names
    bert: detect.NameProvider = detect.no_names


def gated_spans(text: Column, plan: Plan | None = None, providers: Providers | None = None) -> Column:
    """Spans of the enabled layers, resolved within each type. Layers that are off are not in the plan at all."""
    p, own = providers or Providers(), []
    if plan is None or plan.use_regex:
        own.append(detect.pattern_spans(text))
    if plan is not None and plan.use_spacy:
        own.append(p.spacy(text))
    if plan is not None and plan.use_bert:
        own.append(detect.bert_layer(p.bert, keep_organisations=True)(text))
    return resolve.dedup_same_type(detect.union_of(*own)) if own else empty(SPAN)


def gated(docs: DataFrame, text: str = "text", mode: str = "redact", plan: Plan | None = None, providers: Providers | None = None, min_score: float = 0.0) -> DataFrame:
    """docs with spans, masked_text and summary."""
    out = docs.withColumn("spans", resolve.at_least(gated_spans(F.col(text), plan, providers), min_score)).withColumn("_entries", masking.value_map(F.col("spans"), mode))
    return out.withColumn("masked_text", masking.replace_all(text, F.col("_entries"))).withColumn("summary", summary.summary("spans")).drop("_entries")


def contextual(docs: DataFrame, text: str = "text", mode: str = "redact", providers: Providers | None = None, compose: bool = True, word_boost: float = 0.0) -> DataFrame:
    """docs with cleaned_text (offsets refer to it), spans, masked_text, token_map, and tier counts. Each stage is a projection of its own."""
    p = providers or Providers()
    out = docs.withColumn("cleaned_text", clean(text, compose))
    t = F.col("cleaned_text")
    found = detect.labelled_sources(detect.pattern_spans(t))
    found = detect.context_words_boost(t, found, word_boost) if word_boost else found
    names = detect.without_label_words(p.spacy(t))
    out = out.withColumn("_pairs", detect.label_pairs(t)).withColumn("spans", detect.union_of(found, names, detect.bert_layer(p.bert, keep_organisations=False)(t)))
    steps: list[Callable[[Column], Column]] = [lambda s: context.label_boost(s, F.col("_pairs")), context.proximity_boost, context.anchor_rule, lambda s: context.density_boost(t, s), resolve.dedup_any_type]
    for step in steps:
        out = out.withColumn("spans", step(F.col("spans")))
    out = out.withColumn("_mask", masking.mask_positions(t, resolve.to_mask(F.col("spans")), mode))
    count = lambda name: F.size(F.filter("spans", lambda s: resolve.tier(s["score"], s["standalone_non_pii"]) == name)).cast("bigint")
    return out.select(*docs.columns, "cleaned_text", "spans", F.col("_mask.masked_text").alias("masked_text"), F.col("_mask.token_map").alias("token_map"), count("high").alias("high"), count("medium").alias("medium"), count("low").alias("low"))


def chunked(docs: DataFrame, text: str = "text", n: int = fixed.CHUNKS_SMALL["txt"], mode: str = "redact", count_overlap: bool = False) -> DataFrame:
    """docs with masked_text and spans of long texts: chunks are detected with context on either side and masked on their own.

    A span counts once, in the chunk that its start lies in; with count_overlap also where it is mere context.
    """
    parts = docs.withColumn("_chunks", chunking.with_context(chunking.pack_paragraphs(text, n)))

    def one(c: Column) -> Column:
        lead, size = F.length(c["before"]), F.length(c["text"])

        def both(found: Column) -> Column:
            own = found if count_overlap else F.filter(found, lambda s: (s["start"] >= lead) & (s["start"] < lead + size))
            return F.struct(masking.replace_values(c["text"], masking.value_map(found, mode)).alias("text"), own.alias("spans"))

        # A chunk is put together and searched once for its spans and its masks.
        return let(let(F.concat(c["before"], c["text"], c["after"]), lambda t: gated_spans(t)), both)

    done = parts.withColumn("_done", F.transform("_chunks", one))
    return done.select(*docs.columns, F.array_join(F.transform("_done", lambda c: c["text"]), "").alias("masked_text"), F.flatten(F.transform("_done", lambda c: c["spans"])).alias("spans"), F.size("_chunks").alias("n_chunks"))


PROFILES = {"gated": gated, "contextual": contextual}


def detect_report(docs: DataFrame, text: str = "text", mode: str = "redact", **how) -> DataFrame:
    """The contextual profile with what it has masked, `detected`, and three summaries of that: by type, by layer and by confidence."""
    out = contextual(docs, text, mode, **how).withColumn("_hit", resolve.to_mask(F.col("spans")))
    shown = F.transform("_hit", lambda s: F.struct(s["entity_type"].alias("type"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"), F.round(s["score"], 4).alias("score"), F.coalesce(s["layer"], F.lit("presidio_spacy")).alias("source"), *[s[f].alias(f) for f in ("label_boosted", "proximity_boosted", "slide6_boosted")]))
    layers = ("regex", "presidio_spacy", "indic_bert")
    known = summary.summary(F.transform("_hit", lambda s: s.withField("layer", F.when(s["layer"].isin(*layers), s["layer"]).otherwise("presidio_spacy"))), layers)
    out = out.withColumn("detected", shown).withColumn("_sum", known)
    return out.select(*docs.columns, "cleaned_text", "detected", "masked_text", "token_map", "_sum.pii_summary", "_sum.layer_breakdown", F.struct(F.col("high"), F.col("medium")).alias("confidence_breakdown"))


def detect_text(spark, text: str, mode: str = "redact", profile: str = "report") -> DataFrame:
    """One text, as a DataFrame of one row: the report of the contextual profile, or either profile's own columns."""
    return (PROFILES | {"report": detect_report})[profile](spark.createDataFrame([(text,)], "text string"), mode=mode)


def process_files(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None, attempts: int = 2, **how) -> DataFrame:
    """Files (name, file_type, content) read and masked as `sanitize_files` does; what fails costs its own row alone.

    Each file is read by its type's extractor, in an Arrow UDF that catches what it raises: the file is tried `attempts` times, by itself,
    and then has the error's name and words in `error` and no text. A type without an extractor, an empty content that should not be one and
    a null content are errors of that kind, too. All other files have their results, and `failed` and `retried` go on from there.
    """
    text = readers.extracted_text(files, extractors or readers.EXTRACTORS, attempts)
    good = sanitize_files(text.where("_error IS NULL").drop("_error", "content"), **how)
    bad = text.where("_error IS NOT NULL").drop("content").withColumnRenamed("_error", "error")
    more = {f.name: f.dataType for f in good.schema.fields if f.name not in bad.columns}
    return good.unionByName(bad.select("*", *[F.lit(None).cast(t).alias(n) for n, t in more.items()]))


def failed(done: DataFrame) -> DataFrame:
    return done.where("error IS NOT NULL")


def retried(done: DataFrame, files: DataFrame, key: str = "name", **how) -> DataFrame:
    """done, with the files that failed processed once more and no others: results that are there stay as they are."""
    again = process_files(files.join(failed(done).select(key), key, "left_semi"), **how)
    return done.where("error IS NULL").unionByName(again)


def sanitize_files(files: DataFrame, mode: str = "redact", profile: str = "gated", providers: Providers | None = None) -> DataFrame:
    """Files (name, file_type, text) with their plan and masked text; a file of an unknown type keeps its text unmasked out of the
    result and has an error instead.

    Each file is masked by the layers of its own plan. Plans are few, so each combination of layers is a branch of the query over
    its own files.
    """
    from veilspark.plans.config import plan_column

    planned = files.withColumn("plan", plan_column("file_type", F.octet_length("text") / (1024 * 1024)))
    p, layers = providers or Providers(), ("use_regex", "use_spacy", "use_bert")
    # A layer without a provider finds nothing, so plans that differ in it alone are one.
    given = {"use_regex": True, "use_spacy": p.spacy is not detect.no_names, "use_bert": p.bert is not detect.no_names}
    if profile != "gated":
        done = PROFILES[profile](planned.where("plan IS NOT NULL"), mode=mode, providers=p)
    else:
        done = None
        free = [k for k in layers if given[k]]
        for bits in range(1 << len(free)):
            on = {k: bool(bits >> i & 1) for i, k in enumerate(free)}
            test = F.col("plan").isNotNull()
            for k, v in on.items():
                test &= F.col(f"plan.{k}") == v
            part = gated(planned.where(test), mode=mode, plan=Layers(**{k: on.get(k, False) for k in layers}), providers=p)
            done = part if done is None else done.unionByName(part)
    failed = planned.where("plan IS NULL").select(*planned.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in done.schema.fields[len(planned.columns) :]])
    return done.withColumn("error", F.lit(None).cast("string")).unionByName(failed.withColumn("error", F.lit("unknown file type")))


@dataclass
class Layers:
    """The layers that a plan switches on."""

    use_regex: bool = True
    use_spacy: bool = False
    use_bert: bool = False


def status() -> dict[str, bool]:
    """Which outside libraries are there."""
    import importlib.util

    return {name: importlib.util.find_spec(name) is not None for name in ("spacy", "transformers", "pytesseract", "easyocr", "fitz", "docx", "PIL")}
