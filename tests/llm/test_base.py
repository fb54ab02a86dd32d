"""Fixed spans of operators 5 and 9 against plain loops, on random texts and on the smallest documents."""

import hashlib
import random
import re

from veilspark.llm import pii
from veilspark.llm.queries import queries, table


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_personal_data_on_random_texts():
    r = random.Random(9)
    parts = ["4539 1488 0343 6467", "4539148803436467", "1.2.3.4", "256.1.1.1", "a@b.c", "x@y", "+1 (743) 555-3824", "+", "-", " ", ".", "7", "12", "007", "é", "\n", "@", "0000000000000000"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert pii.fixed(t) == personal(t)


def test_queries_on_documents(spark, small):
    texts = {r.doc_id: r.text or "" for r in table(spark, small, "documents").collect()}
    for r in queries()["op9_pii"](spark, small).collect():
        own = personal(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in own) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(own).encode()).hexdigest()
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in queries()["op5_secret_scan"](spark, small).collect():
        t = texts[r.doc_id]
        own = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        own += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        own += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(own)).encode()).hexdigest()


def test_held_out_accuracy(spark, small):
    lang = {r.doc_id: r.lang for r in table(spark, small, "documents").collect()}
    rows = [r for r in queries()["op8_language_id"](spark, small).collect() if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows)
    good = {r.doc_id: r.quality for r in table(spark, small, "labels").collect() if r.quality is not None}
    rows = [r for r in queries()["op10_quality_classifier"](spark, small).collect() if r.held_out and r.doc_id in good]
    assert sum(r.predicted == good[r.doc_id] for r in rows) >= 0.8 * len(rows)
