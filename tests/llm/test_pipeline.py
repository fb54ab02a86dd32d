"""The pipeline on the smallest tables, held against what its stages promise."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_base import personal
from test_operators import slow_schedule

import corpus_pipeline
from veilspark.llm import langid, mixing, packing, pii
from veilspark.llm.queries import queries, vocabulary


def test_stages(spark, small, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert seen["near duplicates"] == seen["personal data"] == seen["mixing"] <= seen["language ID"] <= 200
    last = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for r in docs.collect():
        ids = whole.encode(last[r.doc_id], add_special_tokens=False).ids + [0]
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_sequences_follow_the_mix(spark):
    # Sources differ in length, and one comes first by doc_id; weights 600**0.7 to 200**0.7.
    rows = [(i, ("one two three " * (7 if i < 600 else 11)) + str(i), "en", "a" if i < 600 else "b", 1) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mix = lambda slim: mixing.pfair_mix(slim, block=4, tie="_tie").withColumnRenamed("mix_position", "position")
    out = packing.ordered_packing(docs, vocabulary("byte_bpe_50k.json"), mix, keep=("source",), capacity=128, stretch=40).collect()
    share = 600**0.7 / (600**0.7 + 200**0.7)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    assert sorted(by) == list(range(len(by))) and len({r.doc_id for r in out}) == 800
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    seen, total = 0, 0
    for s in sorted(by):
        seen, total = seen + len({r.doc_id for r in by[s] if r.doc_id < 600}), total + len({r.doc_id for r in by[s]})
        if 40 <= total <= 400:  # before a source is used up: within a stretch and a block
            assert abs(seen - total * share) <= 24
    # Without the mix the sequences are others.
    plain = packing.ordered_packing(docs, vocabulary("byte_bpe_50k.json"), lambda slim: slim.withColumn("position", F.col("doc_id")), keep=("source",), capacity=128, stretch=40).collect()
    together = lambda found: {frozenset(r.doc_id for r in found if r.sequence_id == s) for s in {r.sequence_id for r in found}}
    assert together(plain) != together(out)
    assert sorted(r.doc_id for r in corpus_pipeline.pack(spark, docs, "").collect()) == list(range(800))


def slow_language(text, langs, p, pieces):
    """(language, share), word by word and piece by piece."""
    total, words = np.zeros(len(langs)), langid.LETTERS.findall((text or "").lower())
    for w in words:
        w = "▁" + w
        alpha = [np.ones(len(langs))]
        for end in range(1, len(w) + 1):
            ids = [(size, pieces.ids.get(w[end - size : end], pieces.n if size == 1 else None)) for size in range(1, end + 1)]
            alpha.append(sum(alpha[end - size] * p[i] for size, i in ids if i is not None))
        total = total + np.log(np.maximum(alpha[-1], 1e-300))
    if not words:
        return "und", 0.0
    share = np.exp((total - total.max()) / np.sqrt(len(words)))
    return langs[int(share.argmax())], share.max() / share.sum()


def test_run_equals_brute_force(spark, small):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    # Language ID
    langs, p = langid.learn(docs, vocabulary("piece_bpe_32k.model"))
    pieces = langid.Pieces.load(vocabulary("piece_bpe_32k.model"))
    left = {i for i, r in rows.items() if (x := slow_language(r.text, langs, p, pieces))[0] != "und" and x[1] >= 0.5}
    # Near duplicates
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", rows[i].text or "") for i in left}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in left}
    for _ in range(len(left)):
        moved = False
        for i in left:
            for j in left:
                if i < j and root[i] != root[j] and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
                    moved = True
        if not moved:
            break
    left = sorted(i for i in left if root[i] == i)
    # Personal data: fixed patterns by plain search, the trees' spans as they say
    texts, model = {}, pii.train()
    for i in left:
        t = rows[i].text
        base, every = pii.spans_of([t], *model)[0]
        assert base == personal(t)
        out, at = "", 0
        for a, k, b in every:
            if a >= at:
                out += t[at:a] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, b)
        texts[i] = out + t[at:]
    # Mixing
    frame = spark.createDataFrame([(i, rows[i].source, texts[i]) for i in left], "doc_id long, source string, text string")
    order = {}
    for r in sorted(frame.select("doc_id", "source", F.xxhash64(F.lit(11), F.col("doc_id"), F.xxhash64("text")).alias("h")).collect(), key=lambda r: (r.h % 64, r.h)):
        order.setdefault(r.source, []).append(r.doc_id)
    counts = {s: len(x) for s, x in sorted(order.items(), key=lambda x: (x[0] is not None, x[0] or ""))}
    want = slow_schedule(counts, {s: n**0.7 for s, n in counts.items()}, 32)
    mixed = [i for s, k in sorted(((s, k) for s in counts for k in range(len(want[s]))), key=lambda x: want[x[0]][x[1]][0]) for i in order[s][32 * k : 32 * k + 32]]
    got = corpus_pipeline.mix_sources(spark, frame, small)
    assert [r.doc_id for r in got.collect()] == mixed
    # Packing
    whole, pieces_ = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), set()
    for i in left:
        ids = whole.encode(texts[i], add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        pieces_ |= {(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    out = corpus_pipeline.run(spark, small).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == pieces_ and len(out) == len(pieces_)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in sorted(own)[:k]) == at for own in by.values() for k, (at, _) in enumerate(sorted(own))) and max(sum(n for _, n in own) for own in by.values()) <= 2048
    assert len(by) <= sum(packing.best_fit(Counter(r.length for r in out), 2048).values())
    place = {i: k for k, i in enumerate(mixed)}
    centre = [np.mean([place[r.doc_id] for r in out if r.sequence_id == s]) for s in sorted(by)]
    assert np.corrcoef(centre, np.arange(len(centre)))[0, 1] > 0.8


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries()] == list(range(1, 14))
