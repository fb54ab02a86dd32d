"""WARC archives, periodic runs and fill-in-middle against brute force and round trips."""

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import fim, periodic, queries, warc

R = random.Random(12)
SAME = "é<html>" * 40
PAGES = [
    (9001, "http://a b\r\nX: y/é", SAME), (9000, None, SAME), (9002, "u", "short"), (9003, "u", "short"), (9004, "u", None), (9005, "u", ""), (None, "u", SAME), (9000, None, SAME),
    (None, "v", "n" * 100), (None, "v", "n" * 100), (9010, "w", "k" * 99), (9011, "w", "k" * 99), (9012, "w", "k\r\n\r\n" * 50), (9013, "w", "k\r\n\r\n" * 50), (9020, "x", "long " * 300_000),
    *((i, f"http://h/{i}", f"<p>{i % 7}</p>" * (5 + i % 30)) for i in range(300)),
]


def pages_of(spark, rows):
    clash = [(*r, "c", 1, "k") for r in rows]
    return spark.createDataFrame(clash, "page_id long, url string, html string, key string, `first.x` int, digest string").repartition(3)


def expected(rows):
    """Per row: key, bytes, digest, kind, page referred to, payload."""
    groups = {}
    for key, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(key)
    out = Counter()
    for key, _, html in rows:
        b = (html or "").encode()
        first = min((k for k in groups[b] if k is not None), default=None)
        again = len(b) >= 100 and first is not None and key != first
        out[str(key), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(first) if again else None, None if again else b] += 1
    return out


@pytest.fixture(scope="module")
def index(spark):
    return warc.write(pages_of(spark, PAGES), archive_bytes=20_000)


def test_records_come_back(index):
    for gap, size in ((0, 1000), (500, 10_000), (1 << 20, 1 << 30)):
        got = warc.read(index, gap=gap, range_bytes=size).collect()
        assert Counter((str(r.key), r.payload_bytes, r.digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == expected(PAGES)
    assert {r.url for r in got if r.key == "9001"} == {"http://a%20b%0D%0AX:%20y/é"}
    assert {r.url for r in got if r.key == "9000"} == {None}


def test_archives_are_gzip_members_and_can_be_indexed(spark, index):
    rows = index.collect()
    archives = {r.archive for r in rows}
    assert len(archives) > 3
    for r in rows[:40]:
        with open(r.archive.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            record = gzip.decompress(f.read(r.length))
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and len(rest) - 4 == int(fields[b"Content-Length"])
        assert fields[b"WARC-Type"].decode() == r.record_type and fields[b"WARC-Block-Digest"] == b"sha256:" + hashlib.sha256(rest[:-4]).hexdigest().encode()
    own = warc.index(spark.createDataFrame([(a,) for a in archives], "archive string"))
    assert Counter(map(tuple, own.collect())) == Counter(map(tuple, rows))


def test_revisits_name_their_response(index):
    found = {}
    for r in index.collect():
        with open(r.archive.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            head = gzip.decompress(f.read(r.length)).partition(b"\r\n\r\n")[0].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in head[1:])
        found.setdefault(fields["WARC-Record-ID"], fields)
        if r.record_type == "revisit":
            found[fields["WARC-Record-ID"]] = fields
    revisits = [f for f in found.values() if f["WARC-Type"] == "revisit"]
    assert revisits and all(found[f["WARC-Refers-To"]]["WARC-Type"] == "response" and found[f["WARC-Refers-To"]]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] for f in revisits)


def test_ranges_coalesce(spark):
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 100, 50), ("a", 100, 50), ("b", 0, 10), ("a", 160, 10)]
    chosen = spark.createDataFrame(rows, "archive string, offset long, length long")
    got = sorted((r.archive, r.start, r.end, [tuple(x) for x in r.records]) for r in warc.ranges(chosen, 5, 150).collect())
    assert got == [("a", 0, 30, [(0, 10), (10, 10), (25, 5)]), ("a", 100, 150, [(100, 50), (100, 50)]), ("a", 160, 170, [(160, 10)]), ("b", 0, 10, [(0, 10)])]
    assert warc.read(chosen.limit(0)).count() == 0


def test_payloads_of_revisits_are_looked_up(index):
    some = index.where("record_type = 'revisit' or key = '9005'")
    got = {r.digest: bytes(r.payload) for r in warc.payloads(some, index).collect()}
    want = {d: b for (_, _, d, kind, _, b) in expected(PAGES) if kind == "response"}
    assert set(got) == {r.digest for r in some.collect()} and all(want[d] == b for d, b in got.items())


def test_bad_archives_and_payloads_are_errors(spark, index, tmp_path):
    first = index.where("record_type = 'response' and key = '5'").first()
    with open(first.archive.removeprefix("file://"), "rb") as f:
        data = f.read()
    (tmp_path / "cut.warc.gz").write_bytes(data[:-20])
    with pytest.raises(Exception, match="ends within the record"):
        warc.index(spark.createDataFrame([(f"file://{tmp_path}/cut.warc.gz",)], "archive string")).count()
    record = gzip.decompress(data[first.offset : first.offset + first.length])
    member = gzip.compress(record.replace(b"<p>5</p>", b"<p>6</p>"))
    (tmp_path / "other.warc.gz").write_bytes(member)
    chosen = spark.createDataFrame([(f"file://{tmp_path}/other.warc.gz", 0, len(member))], "archive string, offset long, length long")
    with pytest.raises(Exception, match="not the one that was stored"):
        warc.read(chosen).collect()


def test_foreign_archives(spark, tmp_path):
    """Blocks without an HTTP header, digests of another kind, records of other types, several pieces to a member."""
    big = bytes(R.randrange(256) for _ in range(3 << 20))
    def record(kind, block, *more):
        return gzip.compress(b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, b"Content-Length: %d" % len(block), *more]) + b"\r\n\r\n" + block + b"\r\n\r\n")
    parts = [record(b"warcinfo", b"x"), record(b"response", b"plain", b"WARC-Payload-Digest: sha1:ABC", b"WARC-Target-URI: http://p"), record(b"request", b"GET"), record(b"response", big, b"Content-Type: image/png")]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(parts))
    own = warc.index(spark.createDataFrame([(f"file://{tmp_path}/f.warc.gz",), (None,)], "archive string")).orderBy("offset")
    got = [tuple(r)[1:] for r in own.collect()]
    at = [sum(map(len, parts[:k])) for k in range(5)]
    assert got == [(at[1], len(parts[1]), "http://p", hashlib.sha256(b"plain").hexdigest(), "response", None), (at[3], len(parts[3]), None, hashlib.sha256(big).hexdigest(), "response", None)]
    assert [bytes(r.payload) for r in warc.read(own).orderBy("offset").collect()] == [b"plain", big]


def test_no_pages(spark):
    index = warc.write(pages_of(spark, PAGES).limit(0))
    assert index.count() == 0 and warc.read(index).count() == 0 and warc.payloads(index, index).count() == 0


def brute_runs(w, least):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def random_word():
    sigma = R.choice([1, 2, 2, 3, 4])
    w = [R.randrange(sigma) for _ in range(R.randint(0, 45))]
    if R.random() < 0.5:
        base = [R.randrange(sigma) for _ in range(R.randint(1, 8))]
        w = w[: R.randint(0, 8)] + (base * 6)[: R.randint(2, 40)] + w[: R.randint(0, 8)]
    return w + w[3:] if R.random() < 0.3 else w


def test_factors():
    for _ in range(1500):
        w, at = random_word(), 0
        for b, e, source in periodic.factors(w):
            assert b == at and (source >= 0 or e == b + 1)
            if source >= 0:
                assert source < b and all(w[source + k] == w[b + k] for k in range(e - b))
            longest = max((k for s in range(b) for k in range(len(w) - b + 1) if w[s : s + k] == w[b : b + k]), default=0)
            assert e - b == max(longest, 1)
            at = e
        assert at == len(w)


def test_runs_equal_brute_force():
    for _ in range(6000):
        w, least = random_word(), R.choice([2, 4, 6, 12])
        assert periodic.runs_of(w, least) == brute_runs(w, least)


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_texts(spark):
    texts = [None, "", " \n\t ", "one", "a " * 11, "a " * 12, "a " * 13, "x " + "p q  r\n" * 9 + "y", "é日 😀 " * 300, "w " * 60_000, " ".join(str(i % 9000) for i in range(40_000))]
    texts += [R.choice([" ", "\n", "  "]).join(str(x) for x in random_word()) for _ in range(300)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(0, None, None, None), (6, texts[6], "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, `a.b` int").repartition(3)
    got = periodic.find(docs, ["doc_id", "a.b"]).collect()
    assert Counter((r.doc_id, r["a.b"]) for r in got) == Counter((r[0], r[3]) for r in rows)
    for r in got:
        w = (texts[r.doc_id] or "").split()
        own = [(x.start, x.length, x.period) for x in r.runs]
        # Long texts of one period are told by arithmetic: brute force takes the square of their words.
        want = [(0, len(w), 1)] if len(w) == 60_000 else [(0, len(w), 9000)] if len(w) == 40_000 else brute_runs(w, 12)
        assert r.n_words == len(w) and own == want and r.collapsed == collapsed(w, own)
    assert periodic.find(docs.limit(0), ["doc_id"]).count() == 0


def test_islands_hold_every_run():
    for _ in range(300):
        texts = [random_word() for _ in range(4)]
        text = np.repeat(np.arange(4), [len(w) for w in texts])
        hashes = np.array([hash((x, 5)) & (2**64 - 1) for w in texts for x in w], dtype=np.uint64)
        cover = {i for a, b in periodic.islands(hashes, text, 12) for i in range(a, b)}
        before = 0
        for w in texts:
            assert {before + i for s, n, _ in brute_runs(w, 12) for i in range(s, s + n)} <= cover
            before += len(w)
    distinct = np.arange(1000, dtype=np.uint64)
    assert periodic.islands(distinct, np.zeros(1000, np.int64)) == []


def test_planted_runs(spark, small):
    import zlib

    docs = queries.table(spark, small, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = 0
    for r in queries.with_planted_runs(docs).collect():
        w, h = (texts[r.doc_id] or "").split(), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r.text.split(" ") == [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            seen += 1
        else:
            assert r.text == texts[r.doc_id]
    assert seen > 5


FIM_TEXTS = [None, "", "a", "é", "日本語", "😀" * 7 + "a", "a😀é日" * 500, "has <P> in it", "<<S<P", "<M", "x" * 200_000 + "é", "é" * 70_000 + "z", "\x00\x7f", *["".join(R.choice("aé日😀<PSM> ") for _ in range(R.randint(0, 60))) for _ in range(400)]]


def test_fill_in_middle(spark):
    rows = [(i, t, "c", 1) for i, t in enumerate(FIM_TEXTS)] + [(None, "null key", "c", 2), (5, FIM_TEXTS[5], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, `_t` int").repartition(3)
    got = fim.transform(docs, ["doc_id", "_t"]).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r._t) for r in got) == Counter((r[0], r[3]) for r in rows)
    for r in got:
        t = "null key" if r.doc_id is None else FIM_TEXTS[r.doc_id] or ""
        digest = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        p, m, s = t[:a], t[a:b], t[b:]
        plain = not t or any(x in t for x in fim.MARKS) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        output = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) == (len(t), form, None if plain else a, None if plain else b - a, output, t)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0), ["doc_id"]).count() == 0


def test_class_runs_find_every_cut():
    texts = [t or "" for t in FIM_TEXTS if len(t or "") < 3000]
    raw = "".join(texts).encode()
    own = np.cumsum([0] + [len(t.encode()) for t in texts])
    runs = fim.ClassRuns(np.frombuffer(raw, np.uint8), own)
    for r, t in enumerate(texts):
        cuts = np.arange(len(t) + 1)
        assert (runs.bytes_of(np.full(len(cuts), r), cuts) - own[r]).tolist() == [len(t[:c].encode()) for c in cuts]
    assert len(fim.ClassRuns(np.frombuffer(b"a" * 1000, np.uint8), np.array([0, 1000])).kind) == 1


def test_marks_that_run_into_each_other_are_refused():
    fim.check_marks(("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>"))
    for marks in (("", "b", "c"), ("aba", "x", "y"), ("ab", "bc", "z"), ("abc", "b", "z"), ("a", "a", "b")):
        with pytest.raises(ValueError, match="run into"):
            fim.check_marks(marks)
