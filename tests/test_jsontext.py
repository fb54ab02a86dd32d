"""JSON of any shape against the standard reader and writer."""

import json
import random

from pyspark.sql import functions as F

from veilspark.operators import jsontext, structured

R = random.Random(2)


def node(depth):
    kind = R.random()
    if depth == 0 or kind < 0.45:
        return R.choice(["a", "", "  ", 'x"y\\', "é\n\t", "\u0001z", "{[,:]}", 1, -2.5, True, False, None, 'q: 1, "b"', "/", " ", "😀"])
    if kind < 0.75:
        return {R.choice(["a", "b.c", 'k"', "é", "", "x y"]) + str(i): node(depth - 1) for i in range(R.randint(0, 4))}
    return [node(depth - 1) for _ in range(R.randint(0, 4))]


def walk(x, path="$"):
    if isinstance(x, dict):
        for k, v in x.items():
            yield from walk(v, f"{path}.{k}")
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from walk(v, f"{path}[{i}]")
    elif isinstance(x, str):
        yield path, x


def each(x, change):
    if isinstance(x, dict):
        return {k: each(v, change) for k, v in x.items()}
    if isinstance(x, list):
        return [each(v, change) for v in x]
    return change(x) if isinstance(x, str) else x


BAD = ["", "{", '{"a":1}}', "[1,]", '"x" y', "nope", '{"a" 1}', None, "[1 2]", "{]"]


def test_any_shape(spark):
    texts = [json.dumps(node(4), ensure_ascii=R.random() < 0.5, indent=R.choice([None, 2, 4]), separators=R.choice([None, (",", ":")])) for _ in range(500)]
    df = spark.createDataFrame([*enumerate(texts), *((9000 + i, t) for i, t in enumerate(BAD))], "i int, t string")
    marked = lambda values: F.transform(values, lambda v: F.concat(F.lit("<"), v, F.lit(">")))
    found = df.select("i", jsontext.leaves("t", blank=True).alias("all"), jsontext.leaves("t").alias("own"), jsontext.rewritten("t", marked).alias("r"), jsontext.written("t", 2).alias("p"), jsontext.written("t").alias("w"), jsontext.is_json("t").alias("ok"))
    got = {r.i: r for r in found.collect()}
    for i, t in enumerate(texts):
        x, r = json.loads(t), got[i]
        assert r.ok and [tuple(leaf) for leaf in r.all] == [(p, k, v) for k, (p, v) in enumerate(walk(x))]
        assert [leaf.value for leaf in r.own] == [v for _, v in walk(x) if v.strip()]
        assert (r.r, r.p, r.w) == (json.dumps(each(x, lambda v: f"<{v}>"), ensure_ascii=False), json.dumps(x, ensure_ascii=False, indent=2), json.dumps(x, ensure_ascii=False))
    for i in range(len(BAD)):
        r = got[9000 + i]
        assert not r.ok and r.own is None and r.r is None and r.p is None
    assert df.limit(0).select(jsontext.leaves("t")).count() == 0


def test_values_in_leaves(spark):
    """Few values by built-ins without a Python worker, many in one pass; keys and numbers stay; numbers keep their spelling."""
    text = '{"mail": "a mail v7 to v70", "n": 1.50, "x": ["mail", {"v7": "v7\\u00e9"}]}'
    pairs = [("mail", "[M]"), *((f"v{i}", f"<{i}>") for i in range(80))]
    df = spark.createDataFrame([(text, pairs), (text, pairs[:9]), ("no json", pairs)], "t string, e array<struct<value:string,to:string>>")
    many = structured.mask_json_values(df, "t", "e").withColumnRenamed("masked_json", "j")
    few = df.select(structured.mask_json_text("t", F.col("e")).alias("j"))
    want = ['{"mail": "a [M] <7> to <70>", "n": 1.50, "x": ["[M]", {"v7": "<7>é"}]}', '{"mail": "a [M] <7> to <7>0", "n": 1.50, "x": ["[M]", {"v7": "<7>é"}]}', None]
    assert [r.j for r in many.collect()] == want == [r.j for r in few.collect()]
    assert "Python" not in few._jdf.queryExecution().toString()


def test_sanitize_json(spark):
    text = json.dumps({"a": "mail x@y.com", "b": [" ", {"c": "PAN ABCDE1234F and x@y.com"}], "n": 1234})
    out = structured.sanitize_json(spark.createDataFrame([(1, text, "c"), (2, "broken {", None), (3, None, None)], "id int, text string, leaves string"), mode="tokenize").orderBy("id").collect()
    assert json.loads(out[0].masked_json) == {"a": "mail <<EMAIL_ADDRESS_001>>", "b": [" ", {"c": "PAN <<PAN_001>> and <<EMAIL_ADDRESS_001>>"}], "n": 1234}
    assert [(x.path, x.leaf_idx, [s.entity_type for s in x.spans]) for x in out[0].leaves] == [("$.a", 0, ["EMAIL_ADDRESS"]), ("$.b[1].c", 2, ["PAN", "EMAIL_ADDRESS"])]
    assert out[1].masked_json is None and out[1].leaves is None and out[2].masked_json is None
