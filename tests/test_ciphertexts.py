"""Ciphertexts of three forms: published vectors of the cipher mode, round trips, and what cannot be read."""

import base64

import pytest
from pyspark.sql import functions as F

from veilspark.functions import crypto

KEY = "feffe9928665731c6d6a8f9467308308"
TEXT = "d9313225f88406e5a55909c5aff5269a86a7a9531534f7da2e4c303d8a318a721c3c0c95956809532fcf0e2449a6b525b16aedf5aa0de657ba637b39"
MORE = "feedfacedeadbeeffeedfacedeadbeefabaddad2"
#: Nonces of 12, 8 and 60 bytes: the published test cases 4, 5 and 6 of the mode.
CASES = [
    ("cafebabefacedbaddecaf888", "42831ec2217774244b7221b784d0d49ce3aa212f2c02a4e035c17e2329aca12e21d514b25466931c7d8f6a5aac84aa051ba30b396a0aac973d58e091", "5bc94fbc3221a5db94fae95ae7121a47"),
    ("cafebabefacedbad", "61353b4c2806934a777ff51fa22a4755699b2a714fcdc6f83766e5f97b6c742373806900e49f24b22b097544d4896b424989b5e1ebac0f07c23f4598", "3612d2e79e3b0785561be14aaca2fccb"),
    ("9313225df88406e555909c5aff5269aa6a7a9538534f7da1e4c303d2a318a728c3c0c95156809539fcf0e2429a6b525416aedbf5a0de6a57a637b39b", "8ce24998625615b603a033aca13fb894be9112a5c3a211a8ba262a3cca7e2ca701e4a9a4fba43c90ccdcb281d48c7c6fd62875d2aca417034c34aee5", "619cc5aefffe0bfa462af43c1699d050"),
]


@pytest.mark.parametrize(("nonce", "coded", "tag"), CASES)
def test_published_vectors(spark, nonce, coded, tag):
    def cipher(data):
        row = spark.range(1).select(F.aes_encrypt(F.lit(data), F.lit(bytes.fromhex(KEY)), F.lit("ECB")).alias("x")).first()
        return bytes(row.x)[: len(data)]

    ghash, text = crypto.Ghash(cipher(bytes(16))), bytes.fromhex(TEXT)
    stream = cipher(crypto.counter_blocks(bytes.fromhex(nonce), len(text), ghash))
    assert crypto.sealed(text, stream, ghash, bytes.fromhex(MORE)) == (bytes.fromhex(coded), bytes.fromhex(tag))
    assert crypto.sealed(bytes.fromhex(coded), stream, ghash, bytes.fromhex(MORE), reading=True) == (text, bytes.fromhex(tag))


def test_forms(spark):
    key = F.lit("0123456789abcdef0123456789abcdef")
    texts = ["x", "secret é 😀", "a" * 15, "a" * 16, "a" * 500, "", None, "plain: text", "a:b:c", "enc:no"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("nonce", F.unhex(F.md5(F.col("i").cast("string").cast("binary"))))
    df = df.withColumn("colons", crypto.encrypt_colons("t", key, F.col("nonce"))).withColumn("dots", crypto.encrypt_dotted("t", key)).withColumn("own", crypto.encrypt("t", key))
    got = df.select("*", *[crypto.read_any(c, key).alias(f"{c}_back") for c in ("colons", "dots", "own", "t")], crypto.read_any("colons", F.lit("f" * 32)).alias("other"), crypto.read_any("dots", F.lit("f" * 32)).alias("other2")).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        assert r.colons_back == r.dots_back == r.own_back == r.t_back == t
        if t:
            nonce, tag, coded = (base64.b64decode(x) for x in r.colons.split(":"))
            assert len(nonce) == len(tag) == 16 and len(coded) == len(t.encode()) and r.other == r.other2 == crypto.FAILED
            assert r.dots.startswith("enc:") and [len(base64.b64decode(x)) for x in r.dots[4:].split(".")] == [12, 16, len(t.encode())]
    short = spark.createDataFrame([("AAAA:BBBB:CCCC",), (got[0].colons + "=",), (got[0].colons[:-4] + "AAA=",)], "v string").select(crypto.read_any("v", key).alias("x")).collect()
    assert short[0].x == "AAAA:BBBB:CCCC" and short[1].x in (crypto.FAILED, got[0].colons + "=") and short[2].x == crypto.FAILED
