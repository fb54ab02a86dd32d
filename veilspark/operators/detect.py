"""Span producers: the pattern layer, label pairs, name recognisers, and filters on what they find."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.core import SIGN, SPAN, col, empty, found_by, let, lookup, matches, numbered, placed, running, span, strip

Pattern = tuple[str, str, float, str]

#: What any pattern's match must hold; texts without it are spared all of them.
NEEDED = r"[0-9@_]|[a-f]{32}|android-|ios-"

#: What each match of a pattern that is searched for by itself holds: texts without it are spared the pattern.
HELD = {"in_phone_plus91": "+91", "upi_vpa": "@", "biometric_fp_hash": "fp_hash_", "biometric_face_tmp": "face_tmp_", "device_ios": "ios-", "std_email": "@"}
#: Starts of patterns, and the same with a sign looked at before the word border is worked out, or without steps back that lead nowhere.
QUICKER = ((r"\b[A-Za-z0-9._%+\-]+@", r"\b[\w.%+\-]++@"), (r"(?:\+91[\s\-]?)", r"\+91[\s\-]?"), (r"\b[\w.\-+]+@", r"\b[\w.\-+]++@"), (r"\b(?:4\d{3}|5[1-5]\d{2}|6011|3[47]\d{2})", r"[3-6](?<=\b[3-6])(?:(?<=4)\d{3}|(?<=5)[1-5]\d{2}|(?<=6)011|(?<=3)[47]\d{2})"), (r"\b\d{9,18}", r"\d(?<=\b\d)\d{8,17}"), (r"\b(?:(?:25[0-5]", r"(?=[0-9])\b(?:(?:25[0-5]"))
#: A word border, then one sign of a class, a digit or a letter that must be there.
BORDER = re.compile(r"\\b(\[[A-Za-z0-9-]+\]|\\d|[A-Za-z0-9])(?:\{(\d+)\})?(?![?*+{])")

_registered: list[Pattern] = []


def register_pattern(entity: str, name: str, regex: str, score: float, context: Iterable[str] = ()) -> bool:
    """Adds a pattern to the catalog; a pattern that does not compile is left out, as the catalog must not fail."""
    try:
        re.compile(regex)
    except re.error:
        return False
    _registered.append((entity, name, score, regex))
    fixed.CONTEXT_WORDS.setdefault(entity, []).extend(context)
    return True


@contextlib.contextmanager
def registering() -> Iterator[None]:
    """Patterns that are registered within hold until its end: another session's catalog is as it was."""
    patterns, words = list(_registered), {k: list(v) for k, v in fixed.CONTEXT_WORDS.items()}
    try:
        yield
    finally:
        _registered[:] = patterns
        fixed.CONTEXT_WORDS.clear()
        fixed.CONTEXT_WORDS.update(words)


def catalog() -> list[Pattern]:
    return [*fixed.PATTERNS, *_registered]


def quick(regex: str) -> str:
    """A pattern with the same matches that is found sooner: a word border is dear, and would be worked out at every sign of a text."""
    for start, same in QUICKER:
        if regex.startswith(start):
            return same + regex[len(start) :]
    m = BORDER.match(regex)
    if not m:
        return regex
    n = int(m[2] or 1)
    return f"{m[1]}(?<=\\b{m[1]})" + (f"{m[1]}{{{n - 1}}}" if n > 1 else "") + regex[m.end() :]


#: Patterns that one search finds, with the lengths of their matches. No two of a group match at one place, nor at one length, so group and length tell the pattern.
GROUPS = (
    {"cvv_3digit": (3,), "cvv_4digit": (4,), "passport_in": (8,), "in_phone_bare": (10,), "in_phone_0prefix": (11,), "aadhaar_plain": (12,), "aadhaar_vid_plain": (16,), "biometric_hex_hash": (32, 64), "device_uuid": (36,)},
    {"account_9to18_digits": range(9, 19), "aadhaar_vid_spaced": (19,)},
    {"pan_standard": (10,), "in_phone_split_5_5": (11,), "aadhaar_spaced": (14,), "aadhaar_vid_dashed": (19,)},
    {"ifsc_standard": (11,), "aadhaar_dashed": (14,)},
    {"in_phone_split_4_6": (11,), "aadhaar_dotted": (14,)},
    {"in_phone_split_3_7": (11,), "aadhaar_slashed": (14,)},
    {"std_cc": range(16, 20)},
    {"std_ip": range(7, 16), "device_android": range(16, 66)},
)
#: Longer matches are of a pattern without a longest length, and count as so long.
LONGEST = 65
_PLACES = {p[1]: i for i, p in enumerate(fixed.PATTERNS)}
#: Places of the patterns that are searched for one by one: their matches begin at other places than behind a sign, or at many of one word.
ALONE = [i for name, i in _PLACES.items() if not any(name in g for g in GROUPS)]
#: Place of the pattern by group and length, written as a text, which plans hold as one value.
BY_LENGTH = ",".join(str(next((_PLACES[name] for name, lengths in g.items() if n in lengths), -1)) for g in GROUPS for n in range(LONGEST + 1))
#: A sign, and behind it what matches there, a part for each group. Only its head can fail: a word border, and what the patterns begin with.
AT_ONCE = r"\W(?=[\dA-Za-f][\dA-Za-fn.][\dA-Za-fd.])(?=\d|[A-Z]{1,5}\d|\p{XDigit}{8}|android-)\b" + "".join("(?=(" + "|".join(fixed.PATTERNS[_PLACES[name]][3].removeprefix(r"\b") for name in g) + ")?)" for g in GROUPS)
#: A sign that no pattern of the fixed catalog knows, as it knows none for SIGN.
OTHER = "\x02"
HIT = "struct<place:int,start:int,end:int,value:string>"
#: So many matches are put one behind another at most, as each step copies them.
BLOCK = 256


def _hit(place: Column, start: Column, end: Column, value: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), start.cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"))


def _alone(text: Column) -> Column:
    """Hits of the patterns in ALONE, a search for each."""

    def turns(pattern: Pattern) -> Column:
        """Gaps and matches in turn; what stands second is null or missing where there are none."""
        own, held = F.split(F.regexp_replace(text, quick(pattern[3]), f"{SIGN}$0{SIGN}"), SIGN, -1), HELD.get(pattern[1])
        return F.when(F.contains(text, F.lit(held)), own) if held else own

    def hits(x: Column) -> Column:
        every = lambda ends: F.transform(F.sequence(F.lit(1), F.size(ends) - 1, F.lit(2)), lambda i: _hit(x["place"], F.get(ends, i - 1), F.get(ends, i), F.get(x["turns"], i)))
        # Nobody asks where the last gap ends.
        return let(running(F.transform(F.slice(x["turns"], F.lit(1), F.size(x["turns"]) - 1), lambda t: F.length(t))), every)

    # What a lambda gives is copied, so gaps stay within it, and spans take their form last.
    each = F.array(*[F.struct(turns(fixed.PATTERNS[i]).alias("turns"), F.lit(i).alias("place")) for i in ALONE])
    return F.flatten(F.transform(F.filter(each, lambda x: F.get(x["turns"], F.lit(1)).isNotNull()), hits))


def _together(text: Column) -> Column:
    """Hits of the patterns in GROUPS, among them those that overlap another of their pattern."""
    n = len(GROUPS) + 1
    # A gap, a part for each group, the next gap and so on. Matches stand in the gaps as well, so these make up the text, behind a sign for its start.
    marked = F.split(F.regexp_replace(F.concat(F.lit("\n"), text), AT_ONCE, f"$0{SIGN}" + "".join(f"${k}{SIGN}" for k in range(1, n))), SIGN, -1)
    place = lambda j, m: F.get(F.split(F.lit(BY_LENGTH), ",").cast("array<int>"), (j % n - 1) * (LONGEST + 1) + F.least(F.length(m), F.lit(LONGEST)))
    hit = lambda j, start, m: _hit(place(j, m), start, start + F.length(m), m)

    def hits(parts: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(0), F.size(parts) - 2, F.lit(n)), lambda j: F.length(F.get(parts, j)))
        full = F.array_compact(F.transform(parts, lambda m, j: F.when((m != "") & (j % n != 0), j)))
        every = lambda starts: F.transform(full, lambda j: hit(j, F.get(starts, F.floor(j / n).cast("int")), F.get(parts, j)))
        return F.when(F.size(parts) == 1, empty(HIT)).otherwise(let(running(gaps, zero=-1), every))

    return let(marked, hits)


def _leftmost(found: Column) -> Column:
    """Hits by place and start without those that overlap one of their pattern that stays, as a search from the left would find them.

    Of one pattern, what starts later ends later too, so an overlap is one with the hit before.
    """
    meets = lambda a, x: (a["place"] == x["place"]) & (a["end"] > x["start"])

    def put(acc: Column, x: Column) -> Column:
        more = lambda done, own: F.struct(done.alias("done"), own.alias("own"), x.alias("last"))
        turned = more(F.concat(acc["done"], F.array(acc["own"])), F.array(x))
        return F.when(meets(acc["last"], x), acc).when(F.size(acc["own"]) < BLOCK, more(acc["done"], F.concat(acc["own"], F.array(x)))).otherwise(turned)

    start = F.struct(empty(f"array<{HIT}>").alias("done"), empty(HIT).alias("own"), F.lit(None).cast(HIT).alias("last"))
    walked = lambda own: F.aggregate(own, start, put, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["own"]))))

    def judged(own: Column) -> Column:
        over = F.transform(own, lambda x, i: F.coalesce(meets(F.get(own, i - 1), x), F.lit(False)))
        # Where no two in succession overlap what stands before them, the former stays and the latter goes.
        twice = lambda found: F.array_contains(F.transform(found, lambda x, i: x & F.coalesce(F.get(found, i - 1), F.lit(False))), True)
        return let(over, lambda found: F.when(~F.array_contains(found, True), own).when(twice(found), walked(own)).otherwise(F.filter(own, lambda x, i: ~F.get(found, i))))

    return let(found, judged)


def _hits(text: Column) -> Column:
    """Leftmost matches of each pattern of the fixed catalog that do not overlap, by place of the pattern and start."""
    clear = F.when(F.contains(text, F.lit(SIGN)), F.translate(text, SIGN, OTHER)).otherwise(text)
    return let(clear, lambda t: _leftmost(F.sort_array(F.concat(_together(t), _alone(t)))))


def pattern_spans(text: Column | str, patterns: list[Pattern] | None = None, layer: str = "regex") -> Column:
    """Spans of all patterns in catalog order; ord is the order of detection."""
    t = col(text)
    if patterns or _registered:
        # Patterns that are not known may match any sign.
        each = lambda signed: F.array(*[F.struct(found_by(t, quick(p[3]) if p in fixed.PATTERNS else p[3], signed).alias("own"), F.lit(p[0]).alias("entity"), F.lit(p[2]).alias("score")) for p in patterns or catalog()])
        # Places are worked out by one expression for all patterns that match, so that a plan holds it once.
        hit = F.filter(let(F.contains(t, F.lit(SIGN)), each), lambda x: x["own"]["gaps"].isNotNull())
        spans = lambda x: F.transform(placed(x["own"]["found"], x["own"]["gaps"]), lambda m: span(m["start"], F.lit(0), m["end"], x["entity"], m["value"], x["score"], F.lit(layer)))
        return numbered(F.flatten(F.transform(hit, spans)))

    of = lambda m, k: F.get(F.array(*[F.lit(p[k]) for p in fixed.PATTERNS]), m["place"])
    found = F.transform(_hits(t), lambda m, i: span(m["start"], i, m["end"], of(m, 0), m["value"], of(m, 2), F.lit(layer)))
    return F.when(t.rlike(NEEDED), found).otherwise(empty(SPAN))


def labelled_sources(spans: Column) -> Column:
    """layer by type: patterns of one's own are `regex`, general ones `presidio_spacy`."""
    return F.transform(spans, lambda s: s.withField("layer", F.when(s["entity_type"].isin(*fixed.CUSTOM_TYPES), "regex").otherwise("presidio_spacy")))


def context_words_boost(text: Column | str, spans: Column, boost: float = 0.35, floor: float = 0.4, reach: int = 40) -> Column:
    """Spans whose type has a context word within `reach` code points before them score higher; size and reach are parameters."""
    t = col(text)

    def lifted(s: Column) -> Column:
        before = F.lower(F.substring(t, F.greatest(F.lit(1), s["start"] - reach + 1), F.least(F.lit(reach), s["start"])))
        near = F.lit(False)
        for kind, words in fixed.CONTEXT_WORDS.items():
            near |= (s["entity_type"] == kind) & before.rlike("|".join(map(re.escape, words)))
        return s.withField("score", F.when(near, F.least(F.lit(1.0), F.greatest(s["score"] + boost, F.lit(floor)))).otherwise(s["score"]))

    return F.transform(spans, lifted)


def without_label_words(spans: Column) -> Column:
    """Drops names that are field labels or run over a line end."""
    words = list(fixed.LABEL_WORDS)
    return F.filter(spans, lambda s: ~(s["entity_type"].isin(*fixed.NAME_TYPES) & (F.lower(strip(s["value"])).isin(*words) | F.contains(s["value"], F.lit("\n")))))


#: A provider maps a text column to an array of SPAN. Statistical models plug in here as an Arrow UDF.
NameProvider = Callable[[Column], Column]


def no_names(text: Column) -> Column:
    return empty(SPAN)


def gazetteer(names: dict[str, str], layer: str = "spacy", score: float = fixed.NAME_LAYER_SCORE) -> NameProvider:
    """A deterministic provider: names and their types."""

    own = [(kind, name, score, rf"\b{re.escape(name)}\b") for name, kind in names.items()]
    return (lambda text: pattern_spans(text, own, layer)) if own else no_names


def bert_layer(provider: NameProvider, keep_organisations: bool) -> NameProvider:
    """A provider limited to the head of the text, its labels mapped to PERSON and LOCATION, and ORGANIZATION where that is kept."""
    kinds = {"PER": "PERSON", "LOC": "LOCATION", "GPE": "LOCATION"} | ({"ORG": "ORGANIZATION"} if keep_organisations else {})

    def find(text: Column) -> Column:
        raw = provider(F.left(text, F.lit(fixed.NAME_LAYER_CHARS)))
        known = F.filter(raw, lambda s: s["entity_type"].isin(*kinds))
        return F.transform(known, lambda s: s.withField("entity_type", lookup(s["entity_type"], kinds, s["entity_type"])).withField("layer", F.lit("bert" if keep_organisations else "indic_bert")))

    return find


def union_of(*layers: Column) -> Column:
    """Layers one after another, numbered anew."""
    return numbered(F.concat(*layers))


PAIR = "struct<label:string,value:string,entity_type:string,label_start:int,label_end:int,value_start:int,value_end:int>"
#: Labels, longest first, then a sign and the rest of the line, up to 100 characters.
LABEL_PATTERN = "(?iu)(" + "|".join(re.escape(x) for x in sorted(fixed.LABELS, key=len, reverse=True)) + r")(\s*[:=]\s*)([^\n]{0,100})"


def _quick_labels() -> str:
    """LABEL_PATTERN with the same matches: labels parted by their first letter, which most places of a text fail at once.

    The letters beyond ASCII are those that equal one of ASCII where case does not count.
    """
    own: dict[str, list[str]] = {}
    for label in sorted(fixed.LABELS, key=len, reverse=True):
        own.setdefault(label[0], []).append(re.escape(label[1:]))
    heads = "".join(own) + "".join(own).upper() + "\u0130\u0131\u017f\u212a"
    return f"(?iu)(?-iu:(?=[{heads}]))(" + "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in own.items()) + ")" + LABEL_PATTERN[LABEL_PATTERN.index(r"(\s*[:=]") :]


QUICK_LABELS = _quick_labels()


def label_pairs(text: Column | str) -> Column:
    """Array of label, value, type and offsets, for "label: value" and "label = value"."""
    t = col(text)

    def pair(m: Column) -> Column:
        label, sign, raw = (F.regexp_extract(m["value"], QUICK_LABELS, k) for k in (1, 2, 3))  # a match is short
        value = strip(raw)
        start = m["start"] + F.length(label) + F.length(sign)
        return F.struct(F.lower(label).alias("label"), value.alias("value"), lookup(F.lower(label), fixed.LABELS, F.lit(None).cast("string")).alias("entity_type"), m["start"].alias("label_start"), (m["start"] + F.length(label)).alias("label_end"), start.alias("value_start"), (start + F.length(value)).alias("value_end"))

    return F.filter(F.transform(matches(t, QUICK_LABELS), pair), lambda p: (p["value"] != "") & p["entity_type"].isNotNull())


def column_type(name: str) -> str | None:
    """Type that a column's name tells, at plan time: the leftmost label, and of those the longest."""
    plain = name.lower().replace("_", " ").replace("-", " ")
    hits = [(plain.find(label), -len(label), kind) for label, kind in fixed.LABELS.items() if label in plain]
    return min(hits, key=lambda h: h[:2])[2] if hits else None


def column_type_of(name: Column | str) -> Column:
    """The same for names in a column."""
    plain = F.translate(F.lower(col(name)), "_-", "  ")
    hits = F.array(*[F.struct(F.locate(label, plain).alias("at"), F.lit(-len(label)).alias("n"), F.lit(kind).alias("kind")) for label, kind in fixed.LABELS.items()])
    return F.array_min(F.filter(hits, lambda h: h["at"] > 0))["kind"]
