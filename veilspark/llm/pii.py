"""Personal data in texts: generous candidate generators, judged by gradient-boosted trees.

Fixed patterns for mail addresses, IP addresses, cards and phone numbers are always reported. Beside them high-recall generators
propose overlapping spans (written-out addresses, numbers without a country code, identity and bank numbers, cards that fail their check
digit). Boosted trees give each candidate a probability from its format and its surroundings; a threshold per kind, calibrated on
examples that the trees have not seen, decides; of overlapping choices the likelier stays, and none touches a fixed span.

The tables have no labels of personal data, so trees and thresholds are trained on examples drawn here from templates: a number of
each kind in a fitting sentence against look-alikes (orders, versions, dates, measures, hashes). The number of examples is fixed.

Defined results: null text counts as empty and stays null when redacted; repeated rows give equal results; no rows give no rows;
all columns are kept.
"""

from __future__ import annotations

import bisect
import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import mapped, unclashing

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
#: Fixed patterns.
LOCAL, HOST = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: The sign and host of a written-out mail address.
WRITTEN = re.compile(r"[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?[A-Za-z0-9-]++(?:(?:\.|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?)[A-Za-z0-9-]++)++")
#: Generators of candidates with digits: kind and pattern. Each looks at a bounded stretch from where it starts.
GENERATORS = (
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])(?:\(?00[1-9][0-9]?\)?[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{10,11}(?![0-9A-Za-z.-])")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{3,4}(?![0-9A-Za-z-])")),
)
#: Words that speak for a kind, and words that speak against all.
FOR = {
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|mastercard|credit|debit|pay", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax|contact|whatsapp|sms|dial", re.I),
    "ssn": re.compile(r"ssn|social|security|tax|identity", re.I),
    "iban": re.compile(r"iban|bank|account|transfer|konto", re.I),
}
AGAINST = re.compile(r"order|invoice|version|part|serial|model|isbn|item|ref|sku|build|date|page|lot|ticket|total|score|sum", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_fits(value: str) -> bool:
    v = value.replace(" ", "")
    return len(v) >= 15 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def local_part(text: str, least: int, end: int) -> int:
    """Where the run of a mail address's signs before `end` starts, not before `least`. Reads that run only, a stretch at a time."""
    start, step = end, 64
    while start > least:
        back = text[max(least, start - step) : start][::-1]
        run = LOCAL.match(back)
        start -= run.end() if run else 0
        if not run or run.end() < len(back):
            break
        step *= 2
    return start


def mails(text: str) -> list[tuple[int, int]]:
    """Leftmost mail addresses: from each @ with a host behind it back to where its run of signs or the match before starts."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        host = HOST.match(text, at + 1)
        if host and (start := local_part(text, last, at)) < at:
            out.append((start, host.end()))
            last = host.end()
        at = text.find("@", max(at + 1, last))
    return out


def fixed(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's rank, end) of the fixed patterns, sorted. Matches that fail their test are dropped, without another try.

    No pattern is tried from within a run that it has read, so time is linear in the text.
    """
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in mails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def proposed(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's rank, end) of the generators' spans, which may overlap."""
    out, last = [], 0
    for m in WRITTEN.finditer(text):
        end = m.start() - (m.start() > last and text[m.start() - 1].isspace())
        start = local_part(text, last, end)
        while start < end and text[start] in "._%+-":
            start += 1
        if start < end:
            out.append((start, 0, m.end()))
            last = m.end()
    if DIGIT.search(text):
        for kind, pattern in GENERATORS:
            out += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    return sorted(set(out))


def describe(text: str, start: int, rank: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    value, kind = text[start:end], KINDS[rank]
    digits = "".join(c for c in value if "0" <= c <= "9")
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    groups = re.findall("[0-9]+", value)
    signs = {c for c in value if not c.isalnum()}
    fits = {"card": lambda: luhn(digits), "iban": lambda: iban_fits(value), "ssn": lambda: digits[:3] not in ("000", "666") and digits[:1] != "9" and digits[3:5] != "00"}.get(kind, lambda: False)()
    near = before.rsplit(None, 4)[-4:]
    return [
        *[float(rank == k) for k in range(len(KINDS))],
        len(value),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        len(set(digits)) / max(1, len(digits)),
        len(signs),
        float("(" in value),
        float(fits),
        float(FOR[kind].search(before) is not None),
        float(FOR[kind].search(after) is not None),
        float(AGAINST.search(" ".join(near)) is not None),
        float(before[-1:] in "#$€£%=/_" and before != ""),
        float(after[:1] in "%/_°" and after != ""),
        float(any(c.isdigit() for c in before[-6:] + after[:6])),
        float(digits[:1] in ("0", "1")),
        float(digits[:4] in ("1900", "2000") or digits[:2] in ("19", "20")),
    ]


class Trees:
    """Gradient-boosted regression trees on the logistic loss: depth `depth`, thresholds at quantiles, Newton steps in the leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, penalty: float = 1.0) -> None:
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.rate, self.trees = rate, []
        f = np.full(len(y), self.start)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 24), method="midpoint")) for j in range(x.shape[1])]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, depth, penalty)
            self.trees.append(tree)
            f += rate * self._apply(tree, x)

    def _grow(self, x, g, h, at, cuts, depth, penalty):
        def gain(i):
            return g[i].sum() ** 2 / (h[i].sum() + penalty)

        best = (1e-6, None, None)
        if depth and len(at) >= 20:
            for j, own in enumerate(cuts):
                for c in own:
                    left = x[at, j] <= c
                    if 5 <= left.sum() <= len(at) - 5:
                        score = gain(at[left]) + gain(at[~left]) - gain(at)
                        if score > best[0]:
                            best = (score, j, c)
        if best[1] is None:
            return float(g[at].sum() / (h[at].sum() + penalty))
        left = x[at, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, at[left], cuts, depth - 1, penalty), self._grow(x, g, h, at[~left], cuts, depth - 1, penalty))

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, c, low, high = tree
        return np.where(x[:, j] <= c, self._apply(low, x), self._apply(high, x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + self.rate * sum(self._apply(t, x) for t in self.trees))))


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of candidates in sentences made from templates."""
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card(good: bool) -> str:
        d = r.choice("3456") + number(14)
        d += next(c for c in "0123456789" if luhn(d + c) == good)
        s = r.choice("- ")
        return s.join(d[i : i + 4] for i in (0, 4, 8, 12))

    def iban(good: bool) -> str:
        country, rest = r.choice(("DE", "FR", "ES", "GB", "NL", "IT")), number(18)
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        value = f"{country}{check if good else (check + r.randint(1, 90)) % 97 + 1:02d}{rest}"
        return value if r.random() < 0.5 else " ".join(value[i : i + 4] for i in range(0, len(value), 4))

    def phone() -> str:
        s = r.choice(" .-")
        area = r.choice("23456789") + number(2)
        return r.choice((f"({area}) {number(3)}{s}{number(4)}", f"{area}{s}{number(3)}{s}{number(4)}", f"0{number(2)}{s}{number(4)}{s}{number(4)}", area + number(7)))

    good = {
        "email": (lambda: f"{word()}.{word()} [at] {word()} [dot] {r.choice(('com', 'org', 'net'))}", ("mail", "write to", "contact", "reach me:")),
        "card": (lambda: card(r.random() < 0.6), ("card number", "visa", "pay with card", "credit card:")),
        "phone": (phone, ("call", "phone:", "tel.", "my mobile is", "fax", "dial")),
        "ssn": (lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{number(4)}", ("ssn", "social security number", "SSN:", "tax identity")),
        "iban": (lambda: iban(True), ("iban", "bank account", "transfer to", "konto")),
    }
    bad = {
        "email": lambda: f"{word()} (at) {word()}.{word()}",
        "card": lambda: card(False),
        "phone": lambda: r.choice((f"{number(2)}.{number(3)}.{number(3)}", f"{number(4)}-{number(4)}-{number(4)}", number(10), f"{r.randint(1900, 2030)} {number(3)} {number(4)}")),
        "ssn": lambda: f"{r.choice(('000', '666', '9' + number(2)))}-{number(2)}-{number(4)}",
        "iban": lambda: iban(False),
    }
    rows, labels, kinds = [], [], []
    while len(rows) < n:
        kind = r.choice(list(good))
        wanted = r.random() < 0.5
        value = good[kind][0]() if wanted or r.random() < 0.25 else bad[kind]()
        lead = r.choice(good[kind][1]) if wanted and r.random() < 0.85 else ("" if wanted else r.choice(("order", "invoice no.", "version", "serial", "ref", "item", "part", "build", word(), word())))
        # A number alone, without words that speak for it, counts as personal only if its own form proves it.
        proof = kind in ("iban", "email") or (kind == "card" and luhn("".join(c for c in value if c.isdigit()))) or "(" in value
        text = " ".join([word() for _ in range(r.randint(2, 8))] + [lead, value] + [word() for _ in range(r.randint(2, 8))])
        for start, rank, end in proposed(text):
            if KINDS[rank] == kind and text[start:end].strip() in value:
                rows.append(describe(text, start, rank, end))
                labels.append(float(wanted and (lead != "" or proof)))
                kinds.append(rank)
    return np.array(rows), np.array(labels), np.array(kinds)


@functools.cache
def train(n: int = 4000, precision: float = 0.98, seed: int = 3) -> tuple[Trees, dict[int, float]]:
    """Trees, and per kind the least threshold with the wanted precision on examples held out."""
    x, y, _ = examples(n, seed)
    trees = Trees(x, y)
    x, y, kinds = examples(n, seed + 1)
    p, out = trees.probability(x), {}
    for k in range(len(KINDS)):
        own, good = p[kinds == k], y[kinds == k]
        order = np.argsort(-own)
        hits = np.cumsum(good[order]) / np.arange(1, len(order) + 1)
        fit = np.flatnonzero(hits >= precision)
        out[k] = max(0.5, float(own[order][fit[-1]])) if len(fit) else 1.1
    return trees, out


def spans_of(texts: list[str], trees: Trees, thresholds: dict[int, float]) -> list[tuple[list, list]]:
    """Per text its fixed spans and all spans, each (start, kind's rank, end), sorted."""
    sure = [fixed(t) for t in texts]
    asked = [(i, c) for i, t in enumerate(texts) for c in proposed(t)]
    p = trees.probability(np.array([describe(texts[i], *c) for i, c in asked])) if asked else []
    more: dict[int, list] = {}
    for (i, c), x in zip(asked, p, strict=True):
        if x >= thresholds[c[1]]:
            more.setdefault(i, []).append((-x, *c))
    out = []
    for i, own in enumerate(sure):
        extra = []
        if i in more:
            taken: list[tuple[int, int]] = []
            for a, _, b in own:  # fixed spans of different kinds may overlap
                if taken and a < taken[-1][1]:
                    taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
                else:
                    taken.append((a, b))
            for _, a, k, b in sorted(more[i]):
                at = bisect.bisect_left(taken, (a, a))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                    taken.insert(at, (a, b))
                    extra.append((a, k, b))
        out.append((own, sorted(own + extra)))
    return out


def _apply(docs: DataFrame, keep: list[str], text: str, model, make, schema: str) -> DataFrame:
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model or train())

    def run(batches):
        trees, thresholds = shared.value
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            columns = make(texts, spans_of([t or "" for t in texts], trees, thresholds))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *[x.split()[0] for x in schema.split(", ")]])

    head = [f"`{c}` {t}" for c, t in frame.select(*[F.col(f"`{c}`") for c in keep]).dtypes]
    return mapped(frame, run, ", ".join([*head, schema]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, keep: list[str], text: str = "text", model=None) -> DataFrame:
    """The columns `keep`, n_email, n_ip, n_card, n_phone (fixed spans), base and spans (kind:start:end, comma-joined)."""

    def make(texts, found):
        counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(4)]
        return [*counts, pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(s) for _, s in found], pa.string())]

    return _apply(docs, keep, text, model, make, "n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact(docs: DataFrame, text: str = "text", model=None) -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans become one. n_chars follows if it is there."""
    plain, names, restored = unclashing(docs)
    own = names[text]

    def make(texts, found):
        out = []
        for t, (_, spans) in zip(texts, found, strict=True):
            if spans:
                parts, at = [], 0
                for a, k, b in spans:
                    if a >= at:
                        parts += [t[at:a], f"[{KINDS[k].upper()}]"]
                    at = max(at, b)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return [pa.array(out, pa.string())]

    out = _apply(plain, [n for n in names.values() if n != own], own, model, make, "_redacted string").withColumnRenamed("_redacted", own)
    if "n_chars" in names:
        n = names["n_chars"]
        out = out.withColumn(n, F.when(F.col(n).isNull(), F.col(n)).otherwise(F.length(own).cast("long")))
    return out.select(*restored)
