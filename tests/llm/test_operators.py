"""The corpus operators against brute force, on small tables with nulls, copies, empty and long texts and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.llm import embedding_dedup, langid, mixing, ngram_join, packing, pii, quality_classifier, quality_rules, secret_scan, suffix_dedup, tokens
from veilspark.llm.common import components
from veilspark.llm.queries import vocabulary

R = random.Random(4)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(150)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, score double, `a.b` int"


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


LONG = prose(3000)
BASE = prose(120)
NEAR = [" ".join([*BASE.split()[:i], "changed", *BASE.split()[i + 1 :]]) for i in (3, 40, 80)]
TEXTS = [BASE, BASE, *NEAR, "", None, "one two", "one two", "x", " \n\t ", LONG, LONG[:900] + " tail " + LONG[2000:3500], prose(60) + "é😀 " + BASE[:420], "ab " * 300, "ab " * 301, prose(40), prose(40).replace(" ", "  "), "!!! ### 12", "a" * 700]


def rows():
    out = [(i, t, ["en", "de", None][i % 3], ["s0", "s0", None, "s1"][i % 4], len(t or ""), "clash", 0.5, 1) for i, t in enumerate(TEXTS)]
    return [*out, out[0], out[3], (None, BASE, "en", "s0", 1, None, None, None), (None, "lone text of seven words right here", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_tokens_equal_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    parts = ["a", "Zb", "é", "ß", "×", "'s", "'ll", " ", "  ", "\n", "\n\n", "\t", ".", "!!", "42", " ", "日本", "\x1c", "\x85", "😀", "the", "don't", "<|endoftext|>", "_", "\x00", "\r\n"]
    texts = ["".join(R.choice(parts) for _ in range(R.randint(0, 25))) for _ in range(500)] + [t or "" for t in TEXTS]
    encoder = tokens.Encoder(vocabulary("byte_bpe_50k.json"), bits=8)  # a small cache is cleared on the way
    assert [ids.tolist() for _, ids in tokens.encoded(pa.array(texts), encoder)] == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = packing.best_fit_packing(docs, vocabulary("byte_bpe_50k.json"), 128).collect()
    want = Counter()
    for r in rows():
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 128 or 128
        cuts = [0, *range(first, len(ids) + 1, 128)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by) <= 1.03 * sum(r.length for r in got) / 128 + 1  # a bound that no packing need reach
    assert packing.best_fit_packing(none, vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_patterns_hold_the_counts():
    for seed in range(6):
        r = random.Random(seed)
        counts = Counter(r.choice((r.randint(1, 100), 33, 50, 100)) for _ in range(400))
        found = Counter()
        for pattern, n in packing.solve(dict(counts), 100).patterns.items():
            assert sum(a * k for a, k in pattern) <= 100
            for a, k in pattern:
                found[a] += n * k
        assert found == counts


def test_packing_comes_from_the_program():
    # The lengths of a corpus: most pieces are full or of medium length, a few are short.
    r = random.Random(2)
    counts = Counter(min(1024, 1 + int(r.lognormvariate(5.5, 0.9))) for _ in range(8000))
    found = packing.solve(dict(counts), 1024)
    assert found.lp_pieces >= found.pieces / 2 and found.pieces == sum(counts.values())
    assert sum(a * n for a, n in counts.items()) / 1024 <= found.bound <= sum(found.patterns.values()) <= sum(packing.best_fit(dict(counts), 1024).values())
    # Where nothing fits beside the longest, the bound is above the tokens' share.
    found = packing.solve({700: 3000, 300: 10}, 1024)
    assert found.bound > 2900 and sum(found.patterns.values()) == 3000 and found.lp_pieces > 1500


def test_rules_statistics(docs, none):
    got = quality_rules.judge(docs, [(("capitals", ">=", 0.5),)]).collect()
    assert len(got) == len(rows()) and quality_rules.judge(none, []).count() == 0
    for r in got:
        w = words(r.text)
        count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")


def test_rules_in_spark_equal_rules_in_python(spark, docs):
    rules = [(("words", ">=", 30.0), ("distinct_words", "<=", 0.9)), (("capitals", ">=", 0.2),), (("marks_per_word", ">=", 0.1), ("word_length", "<=", 4.0), ("repeated_words", ">=", 0.05))]
    judged = quality_rules.judge(docs.withColumnsRenamed({"score": "n_words", "n_chars": "_words", "lang": "_h"}), rules)
    assert len(judged.columns) == len(set(judged.columns)) and "_words" in judged.columns
    for r in judged.select("rule", "kept", "base_failed", *[F.expr(sql).cast("double").alias(name) for name, sql in quality_rules.STATISTICS.items()]).collect():
        want = next((k for k, rule in enumerate(rules, 1) if quality_rules.holds(rule, r.asDict())), None)
        assert r.rule == want and r.kept == (want is None and not r.base_failed)
    for width in (1, 3, 5, 8, 11):
        for r in quality_rules.with_statistics(docs.select("text"), width=width).collect():
            w = words(r.text)
            count = Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
            assert r.n_repeat_words == len({j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(i, i + width)})
    assert quality_rules.tightest((("a", "<=", 0.57), ("b", ">=", 1.0), ("a", "<=", 0.497), ("a", ">=", 0.1))) == (("b", ">=", 1.0), ("a", "<=", 0.497), ("a", ">=", 0.1))


def test_rules_learn():
    r = random.Random(1)
    rows_ = [{n: r.random() for n in quality_rules.STATISTICS} for _ in range(600)]
    bad = [x["capitals"] > 0.8 or (x["symbols_per_word"] > 0.7 and x["words"] < 0.5) for x in rows_]
    rules = quality_rules.cover(rows_, bad)
    hit = [any(quality_rules.holds(rule, x) for rule in rules) for x in rows_]
    assert sum(h == b for h, b in zip(hit, bad)) > 570


def brute_repeats(texts, size):
    data = [(t or "").encode() for t in texts]
    count = Counter(t[s : s + size] for t in data for s in range(len(t) - size + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for s in range(len(t) - size + 1):
            if count[t[s : s + size]] > 1:
                gone[s : s + size] = b"\1" * size
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs, none):
    got = suffix_dedup.remove_repeats(docs).collect()
    want = brute_repeats([r[1] for r in rows()], 200)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((r[0], *w) for r, w in zip(rows(), want))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_of_common_passages(spark):
    # Passages just short of the size stand in many texts between other words: few windows repeat, and those only in part.
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passages = [noise(n) for n in (60, 120, 170, 190, 199, 215, 230, 400)]
    texts = []
    for i in range(600):
        own = r.choice(passages)
        cut = r.randint(0, 30) if i % 3 else 0
        texts.append(noise(r.randint(0, 120)) + own[cut : len(own) - (r.randint(0, 20) if i % 5 == 0 else 0)] + noise(r.randint(0, 120)))
    texts += ["x" * 450, "xy" * 150, texts[7], texts[7] + "é", "é" + texts[8]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 200)))


def test_suffix_dedup_of_a_gram_in_many_contexts(spark):
    # One gram in 20,000 contexts, of which few are equal: the words around it come from a few letters, so cores are shared, too.
    r = random.Random(9)
    gram = "".join(r.choice("0123456789") for _ in range(60))
    texts = ["".join(r.choice(["lorem ", "ipsum ", "dolor "]) for _ in range(14)) + str(r.randint(0, 10**6)) + gram + str(r.randint(0, 10**6)) + "".join(r.choice(["sit ", "amet "]) for _ in range(16)) for _ in range(20_000)]
    texts += texts[:40]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 200)))


def test_loser_tree():
    r = random.Random(3)
    runs = [sorted("".join(r.choice("ab") for _ in range(r.randint(0, 9))).encode() for _ in range(r.randint(0, 30))) for _ in range(7)]
    coded = [suffix_dedup.decoded(*suffix_dedup.front_coded(x)) for x in runs]
    out = list(suffix_dedup.LoserTree(coded))
    assert [k for k, *_ in out] == sorted(k for x in runs for k in x)
    for (a, *_), (b, h, *_) in zip(out, out[1:]):
        assert h == suffix_dedup.common(a, b, 0)


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_ngram_join(docs, none):
    every = [r[:2] for r in rows()]
    sets = [shingles(t) for _, t in every]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    links = Counter(x for p in pairs for x in p)
    got = ngram_join.linked(docs, block=3).collect()
    assert len(got) == len(every)
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((every[i][0], links[i]) for i in range(len(every)))
    root = groups(pairs, range(len(every)))
    left = ngram_join.deduplicate(docs).collect()
    assert len(left) == len(set(root.values())) and left[0].__fields__ == docs.columns
    assert ngram_join.linked(none).count() == 0 and ngram_join.deduplicate(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups([e for e in edges if e[0] != e[1]], {x for e in edges for x in e})
    assert got == want


def test_secrets(spark, docs, none):
    key, token = "AKIA" + "A1B2" * 5, "Zx9+" * 10
    texts = [f'api_key = "abc123def" {key}', "token: token: abcdefgh", f"user_id: alice99 {token} https://h.example/x", token, f"{token} " + "w " * 600 + "user_id: alice99", "0" * 23, "f" * 24 + " PassWord=geheim7", f"username: {token}", f"login: bob77 {'Q' * 230}7{'q' * 20}"]
    got = secret_scan.scan(spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] * 2, "doc_id long, text string, spans string")).collect()
    kinds = {(r.doc_id, tuple(s.kind for s in r.spans)) for r in got}
    assert len(got) == 18
    assert kinds == {(0, ("assign", "access")), (1, ()), (2, ("identifier", "opaque", "endpoint")), (3, ()), (4, ()), (5, ()), (6, ("hex", "assign")), (7, ()), (8, ("identifier", "opaque"))}
    assert secret_scan.scan(docs).count() == len(rows()) and secret_scan.scan(none).count() == 0
    clash = spark.createDataFrame([(1, texts[2], 7, "x", 5, "y")], "doc_id long, text string, _a int, _identifier string, assign int, _la string")
    row = secret_scan.scan(clash).first()
    assert (row._a, row._identifier, row._la) == (7, "x", "y") and len(row.spans) == 3 and row.assign == []


def slow_links(text, scope):
    """Every weak candidate against every part."""
    find = lambda p: [(m.start(), m.end()) for m in re.finditer(p, text)]
    own = {"assign": [(m.start(), m.end()) for m in re.finditer(secret_scan.ASSIGN, text) if len(m[2]) >= 6], "access": find(secret_scan.ACCESS), "hex": find(secret_scan.HEX)}
    own |= {"_identifier": find(secret_scan.IDENTIFIER), "_opaque": find(secret_scan.OPAQUE), "_endpoint": find(secret_scan.ENDPOINT)}
    near = lambda w, q: (q[1] <= w[0] <= q[1] + scope) or (q[0] - scope <= w[1] <= q[0])
    out = [(a, secret_scan.KINDS.index(k), k, b) for k in ("assign", "access", "hex") for a, b in own[k]]
    for name, needed in secret_scan.NEEDS.items():
        out += [(*w[:1], secret_scan.KINDS.index(name[1:]), name[1:], w[1]) for w in own[name] if all(any(near(w, q) for c in secret_scan.PARTS[p] for q in own[c]) for p in needed)]
    return sorted(out)


def test_secret_links_equal_brute_force(spark):
    r = random.Random(12)
    parts = ["AKIA" + "C3D4" * 4, "user_id: ann_1 ", "login=bob@x.de ", "k7J/" * 9 + " ", "https://a.b/c?d=1 ", "f0" * 13 + " ", "token: s3cret99 ", "word ", "und ", "x" * 60 + " ", "é "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(120)]
    for scope in (30, 100):
        got = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scope=scope).collect()
        assert {x.doc_id: [tuple(s) for s in x.spans] for x in got} == {i: slow_links(t, scope) for i, t in enumerate(texts)}


def test_mixing(docs, none, spark):
    got = mixing.pfair_mix(docs, block=2).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(rows())))
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), F.lit("t").alias("text"))
    out = sorted(mixing.pfair_mix(many, {"big": 3.0, **{f"s{i}": 1.0 for i in range(7)}}, block=10).collect(), key=lambda r: r.mix_position)
    seen = 0
    for i, r in enumerate(out[:1500]):  # before the first source is used up
        seen += r.source == "big"
        if i % 10 == 9:
            assert abs(seen - (i + 1) * 0.3) < 10
    assert mixing.pfair_mix(none).count() == 0 and mixing.mixed_order(docs).columns == docs.columns
    clash = docs.withColumnsRenamed({"n_chars": "_before", "score": "_hash", "lang": "mix_block", "_text": "_source"})
    mixed = mixing.pfair_mix(clash, block=2)
    assert mixed.columns == ["doc_id", "text", "source", "_source", "_before", "_hash", "a.b", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position"] or set(mixed.columns) == {*clash.columns, "mix_slot", "mix_release", "mix_deadline", "mix_position"}
    assert {r["_hash"] for r in mixed.collect()} == {0.5, None} and len(mixed.columns) == len(set(mixed.columns))


def slow_schedule(rows, weights, block):
    """Fractions, a scan of all sources in every slot, and the progress of the ideal mix found phase by phase."""
    left = {s: Fraction(-(-n // block)) for s, n in rows.items()}
    blocks, share = dict(left), {s: Fraction(weights[s]) for s in rows}
    marks, t = [(Fraction(0), {s: Fraction(0) for s in rows})], Fraction(0)
    while left:
        total = sum(share[s] for s in left)
        step = min(left[s] * total / share[s] for s in left)
        t += step
        done = dict(marks[-1][1])
        for s in left:
            done[s] += step * share[s] / total
        left = {s: blocks[s] - done[s] for s in left if done[s] < blocks[s]}
        marks.append((t, done))

    def when(s, amount):
        for (t0, a), (t1, b) in zip(marks, marks[1:]):
            if b[s] >= amount > a[s]:
                return t0 + (amount - a[s]) / (b[s] - a[s]) * (t1 - t0)
        return Fraction(0)

    spans = {s: [(math.floor(when(s, Fraction(i))), math.ceil(when(s, Fraction(i + 1)))) for i in range(int(n))] for s, n in blocks.items()}
    at, out = dict.fromkeys(rows, 0), {s: [] for s in rows}
    for slot in range(int(sum(blocks.values()))):
        due, _, _, s = min((spans[s][i][1], s is not None, s or "", s) for s, i in at.items() if i < len(spans[s]) and spans[s][i][0] <= slot)
        assert slot < due
        out[s].append((slot, *spans[s][at[s]]))
        at[s] += 1
    return out


@pytest.mark.parametrize("sources", [3, 7, 20])
def test_schedule_equals_brute_force(sources):
    r = random.Random(sources)
    rows = {f"s{i:02}": r.choice((1, 5, 40, 200, 700)) for i in range(sources)} | {None: 33}
    weights = {s: r.randint(1, 64) / 64 for s in rows}
    got = mixing.schedule(rows, weights, 4).to_pylist()
    want = slow_schedule(rows, weights, 4)
    names = list(rows)
    assert [(x["_at"], x["_of"], x["_slot"], x["_release"], x["_deadline"]) for x in got] == [(k, i, *x) for k, s in enumerate(names) for i, x in enumerate(want[s])]
    by = sorted(got, key=lambda x: x["_slot"])
    size = lambda x: min(4, rows[names[x["_at"]]] - 4 * x["_of"])
    assert [x["_first"] for x in by] == [sum(size(y) for y in by[:i]) for i in range(len(by))]


def test_schedule_keeps_exact_weights():
    for rows, weights in (({"a": 40_000, "b": 40_000, "c": 40_000}, dict.fromkeys("abc", 1.0)), ({"a": 40_000, "b": 80_000, "c": 90}, {"a": 1 / 3, "b": 2 / 3, "c": 0.0004})):
        table = mixing.schedule(rows, weights, 1)
        total, seen = sum(weights.values()), 0
        for k, s in enumerate(rows):
            slots = np.sort(table.column("_slot").to_numpy()[table.column("_at").to_numpy() == k])
            share, i = weights[s] / total, np.arange(len(slots))
            early = slots < min(n * total / weights[x] for x, n in rows.items())  # before the first source is used up
            assert (np.abs(i + 1 - (slots + 1) * share)[early] < 1 + 1e-6).all() and (np.abs(i - slots * share)[early] < 1 + 1e-6).all()
            seen += early.sum()
        assert seen > 90_000


def test_many_sources_are_planned_in_seconds():
    rows = {f"host{i}": 1 + i % 90 for i in range(10_000)}
    began = time.time()
    table = mixing.schedule(rows, {s: n**0.7 for s, n in rows.items()}, 4)
    assert time.time() - began < 20 and sorted(table.column("_slot").to_pylist()) == list(range(table.num_rows))


def test_embeddings(spark):
    r = np.random.default_rng(0)
    centre = r.standard_normal((6, 16))
    data = [(i, (centre[i % 6] + 0.05 * r.standard_normal(16)).tolist(), i % 2) for i in range(240)] + [(1000 + i, r.standard_normal(16).tolist(), 1) for i in range(60)]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, data[0][1], None), (2004, [], 1), (2005, [1.0, None], 1), (2006, [3.0, 4.0], 1), (2007, [6.0, 8.0], 1)]
    every = [*data, *odd, (5000, data[0][1], 0), (5000, data[0][1], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(every, "vec_id long, embedding array<double>, label int"), block=16).collect()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, (_, v, g) in enumerate(every) if g is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    pairs = [(i, j) for i in unit for j in unit if j < i and every[i][2] == every[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    links = Counter(x for p in pairs for x in p)
    assert Counter((r.vec_id, r.n_links) for r in got) == Counter((every[i][0], links[i]) for i in range(len(every)))
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert embedding_dedup.near_duplicates(empty).count() == 0


def test_embeddings_of_dense_groups_that_link(spark):
    r = np.random.default_rng(5)
    at = np.eye(24)[:3]
    turn = lambda a: np.cos(np.radians(a)) * at[0] + np.sin(np.radians(a)) * at[1]
    # Two groups eight degrees apart link with each other, but each vector's likest 149 lie in its own group; the third is far.
    rows = [(150 * g + i, (c + 0.0006 * r.standard_normal(24)).tolist(), "x") for g, c in enumerate((turn(0), turn(8), at[2])) for i in range(150)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert {(r.vec_id // 150, r.n_links, r.component_id) for r in got} == {(0, 299, 0), (1, 299, 0), (2, 149, 300)}


def test_embeddings_of_a_poor_graph(spark, monkeypatch):
    # Neighbours are drawn at random and never refined: the audit sees that, and every label is compared as a whole.
    r = np.random.default_rng(11)
    data = [(i, v.tolist(), int(i % 3 == 0)) for i, v in enumerate(r.standard_normal((300, 8)))]
    data += [(1000 + i, (np.array(v) + 0.01 * r.standard_normal(8)).tolist(), g) for i, v, g in data]

    def drawn(nodes, trees, leaf, most, seed):
        return nodes.select(F.col("_k").alias("u"), F.col("_k").alias("v"), F.lit(0.0).alias("sim"))

    monkeypatch.setattr(embedding_dedup, "_planted", drawn)
    monkeypatch.setattr(embedding_dedup, "_refined", lambda edges, nodes, most: edges)
    report = []
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), block=64, passes=1, report=report).collect()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in data}
    label = {i: g for i, _, g in data}
    links = Counter(x for i in unit for j in unit if j < i and label[i] == label[j] and unit[i] @ unit[j] >= 0.98 for x in (i, j))
    assert report[0] and min(report[0].values()) < 0.1 and report[1] is None
    assert {r.vec_id: r.n_links for r in got} == {i: links[i] for i in unit}


def test_embeddings_of_isolated_pairs(spark):
    r = np.random.default_rng(6)
    a = r.standard_normal((6000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = r.standard_normal((6000, 64))
    b -= (b * a).sum(1)[:, None] * a
    b = 0.981 * a + np.sqrt(1 - 0.981**2) * b / np.linalg.norm(b, axis=1)[:, None]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([a, b]))]
    report = []
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), report=report).where("n_links = 1").count()
    assert got >= 0.995 * len(rows) and min(report[-1].values()) >= embedding_dedup.WANTED


def test_audit_counts_each_vector(spark):
    # Copies with many links are all found, a pair is not.
    rows = [(bytes([i]), "g", np.array([1.0, 0.02 * i / 40]).tobytes(), 1) for i in range(40)] + [(bytes([100 + i]), "g", np.array([0.0, 1.0]).tobytes(), 1) for i in range(2)]
    nodes = spark.createDataFrame(rows, "_k binary, _group string, _v binary, _times long")
    links = spark.createDataFrame([(bytes([i]), 39) for i in range(40)], "_k binary, _links long")
    assert embedding_dedup.audit(nodes, links, 0.98, 500) == {1: 0.0, 6: 1.0}


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces.load(vocabulary("piece_bpe_32k.model"))
    p = np.random.default_rng(1).random((pieces.n + 2, 2)) * 1e-3
    p[-1] = 0

    def brute(w):
        total = np.ones(2) if not w else np.zeros(2)
        for k in range(1, len(w) + 1):
            i = pieces.ids.get(w[:k], pieces.n if k == 1 else None)
            if i is not None:
                total = total + p[i] * brute(w[k:])
        return total

    sample = ["there", "a", "straße", "日本x"]
    got = langid.word_scores([*sample, "ab" * 400], pieces, p)
    assert np.allclose(got[:4], [np.log(brute("▁" + w)) for w in sample]) and np.isfinite(got).all()


def test_expected_uses_equal_brute_force():
    pieces = langid.Pieces.load(vocabulary("piece_bpe_32k.model"))
    p = np.random.default_rng(2).random((pieces.n + 2, 1)) * 1e-3
    p[-1] = 0

    def cuts(w):
        if not w:
            yield ()
        for k in range(1, len(w) + 1):
            i = pieces.ids.get(w[:k], pieces.n if k == 1 else None)
            if i is not None:
                yield from ((i, *rest) for rest in cuts(w[k:]))

    sample, times, want = ["there", "a", "straße", "日本x", "undergo"], np.array([1.0, 3.0, 2.0, 1.0, 5.0]), np.zeros(pieces.n + 2)
    for w, n in zip(sample, times):
        every = list(cuts("▁" + w))
        weight = np.array([np.prod([p[i, 0] for i in c]) for c in every])
        for c, x in zip(every, weight / weight.sum()):
            for i in c:
                want[i] += n * x
    assert np.allclose(langid.expected(sample, times, pieces, p), want)
    long = langid.expected(["ab" * 3000], np.ones(1), pieces, p)  # no word is too long to learn from
    size = np.array([len(x) for x in pieces.ids] + [1, 0])
    assert np.isclose((long * size).sum(), 6001)


def test_letters():
    assert langid.LETTERS.findall("½ ² x² 1a ünd हिन्दी ١ n̈o _ab_") == ["x", "a", "ünd", "हिन्दी", "n̈o", "ab"]


def test_langid(spark, docs, none):
    said = {"en": "the quick brown fox jumps over the lazy dog and then sleeps near the old river", "de": "der schnelle braune fuchs springt und schläft dann nicht weit vom alten fluss"}
    train = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(said.items())] * 5, "doc_id long, text string, lang string")
    path = vocabulary("piece_bpe_32k.model")
    langs, p = langid.learn(train, path)
    asked = spark.createDataFrame([(1, "the old dog near the river"), (2, "nicht weit vom fuchs"), (3, "12 ..."), (4, None), (5, "½ ²")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(asked, langs, p, path, ["doc_id"]).collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}
    got = langid.identify(docs, langs, p, path, ["doc_id"]).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(none, langs, p, path, ["doc_id"]).count() == 0
    langs, p = langid.learn(none, path)
    assert {r.lang_pred for r in langid.identify(docs, langs, p, path, ["doc_id"]).collect()} == {"und"}
    assert langid.keep_identified(docs, path).columns == docs.columns


def test_pii(spark, docs, none):
    text = "mail a.b@c-d.co or 10.2.3.4 and 999.1.1.1, card 4539 1488 0343 6467, call +1 (743) 555-3824 now; write bob (at) site (dot) com"
    model = pii.train()
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"], model=model).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1) and row.spans.startswith(row.base)
    assert "email:" in row.spans[len(row.base) :]
    out = pii.redact(docs, model=model).collect()
    assert len(out) == len(rows()) and sum(r.text is None for r in out) == 1 and pii.redact(none, model=model).count() == 0
    assert pii.redact(spark.createDataFrame([(1, text, 9)], "doc_id long, text string, n_chars long"), model=model).first().text.startswith("mail [EMAIL] or [IP] and")
    x, y, kinds = pii.examples(800, 77)
    chosen = model[0].probability(x) >= np.array([model[1][k] for k in kinds])
    assert (y[chosen] == 1).mean() > 0.93 and chosen[y == 1].mean() > 0.85


def test_scans_are_linear():
    for make in (lambda n: "a" * n + " x@", lambda n: "7" * n + ".", lambda n: "a." * (n // 2) + "@", lambda n: "1." * (n // 2), lambda n: "a@a." * (n // 4), lambda n: "+1 " * (n // 3), lambda n: "x (at) " * (n // 7), lambda n: "- " * (n // 2) + "(at) y"):
        took = []
        for n in (500_000, 1_000_000):
            t, best = make(n), []
            for _ in range(2):
                began = time.process_time()
                pii.spans_of([t], *pii.train()) if n < 0 else (pii.fixed(t), pii.proposed(t))
                best.append(time.process_time() - began)
            took.append(min(best))
        assert took[1] < 2.6 * took[0] + 0.05, (make(20), took)


def slow_features(text, bits):
    """Tokens and pairs one by one, hashed by the rule of the module."""
    m = (1 << 64) - 1

    def mixed(h):
        for _ in range(2):
            h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 & m
        return h ^ (h >> 32)

    tokens_ = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-\x7f]+", text.encode())
    h = [mixed(sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(t)) & m) for t in tokens_]
    out = []
    for i, x in enumerate(h):
        out.append(x >> (64 - bits))
        if i == 0:
            out.append(x >> (64 - bits))
            continue
        pair = mixed((h[i - 1] * 0x9E3779B97F4A7C15 + x) & m)
        pair = int(quality_classifier.SAME_AS_FIRST) if h[i - 1] == x else int(quality_classifier.SAME_AS_SECOND) if i > 1 and h[i - 2] == x else pair
        out.append(pair >> (64 - bits))
    return Counter(out)


def slow_leader(rows_, labels, bits, rounds, alpha, beta, l1, l2):
    """The updates coordinate by coordinate, in dictionaries."""
    z, n, order = Counter(), Counter(), np.random.default_rng(0)
    w = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(rounds):
        for k in order.permutation(len(rows_)):
            own = {i: w(i) for i in rows_[k]}
            error = 1 / (1 + math.exp(-sum(own[i] * x for i, x in rows_[k].items()))) - labels[k]
            for i, x in rows_[k].items():
                g = error * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * own[i]
                n[i] += g * g
    return {i: w(i) for i in z}


def test_classifier_equals_brute_force(spark):
    bits, options = 18, {"rounds": 5, "alpha": 1.0, "beta": 1.0, "l1": 0.2, "l2": 0.5}
    r = random.Random(21)
    texts = [" ".join(r.choice(["buy", "buy", "now!!", "the", "hat", "é", "a-b"]) for _ in range(r.randint(0, 12))) for _ in range(40)]
    labels = [int("now" not in t) for t in texts]
    bias = lambda c: {i: n / math.sqrt(max(1, sum(c.values()))) for i, n in c.items()} | {1 << bits: 1.0}
    slow = [bias(slow_features(t, bits)) for t in texts]
    data = "".join(texts).encode()
    fast = quality_classifier.counted(*quality_classifier.features(np.frombuffer(data, np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]]), bits), bits)
    for a, (at, x) in zip(slow, fast):
        assert a.keys() == set(at.tolist()) and np.allclose([a[i] for i in at.tolist()], x)
    want = slow_leader(slow, labels, bits, *options.values())
    w = quality_classifier.follow_leader(fast, np.array(labels, float), bits, *options.values())
    assert np.allclose([w[i] for i in want], list(want.values())) and np.count_nonzero(w) == sum(x != 0 for x in want.values())
    # One shard of the whole sample, however the rows are dealt to tasks.
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, quality int")
    order = [x.doc_id for x in frame.orderBy(F.xxhash64(F.lit(5), "doc_id")).collect()]
    want = slow_leader([slow[i] for i in order], [labels[i] for i in order], bits, *options.values())
    for tasks in (1, 7):
        w = quality_classifier.learn(frame.repartition(tasks), marks, shards=1, bits=bits)
        assert np.allclose([w[i] for i in want], list(want.values()))
    got = {x.doc_id: x.score for x in quality_classifier.score(frame, w, ["doc_id"]).collect()}
    assert all(np.isclose(got[i], 1 / (1 + math.exp(-sum(w[k] * x for k, x in slow[i].items())))) for i in got)


def test_classifier(spark, docs, none):
    good, bad = [prose(30) for _ in range(60)], [" ".join(["buy!!"] * 5 + [prose(10)]) for _ in range(60)]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    w = quality_classifier.learn(train, labels)
    asked = quality_classifier.score(spark.createDataFrame([(1, prose(25)), (2, "buy!! buy!! " + prose(9))], "doc_id long, text string"), w, ["doc_id"])
    assert {r.doc_id: r.predicted for r in asked.collect()} == {1: 1, 2: 0}
    assert quality_classifier.score(docs, w, ["doc_id", "a.b", "_text", "score"]).columns == ["doc_id", "a.b", "_text", "score", "score", "predicted"]
    assert quality_classifier.score(docs, w, ["doc_id"]).count() == len(rows()) and quality_classifier.score(none, w, ["doc_id"]).count() == 0
    flat = quality_classifier.learn(none, labels)
    assert {r.score for r in quality_classifier.score(docs, flat, ["doc_id"]).collect()} == {0.5}
