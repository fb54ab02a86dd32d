"""Encrypted columns and signed requests.

Two other forms are read and written too: `enc:` with nonce, tag and ciphertext in base64 and dots between them, and the same three with
colons between them, whose nonce has 16 bytes. aes_encrypt takes nonces of 12 bytes alone, so for the latter the cipher's blocks come
from its ECB mode, and only counters and tags, which are polynomials over GF(2^128), are worked out in an Arrow UDF.

Values of one's own are written as "v1:" and base64 of what aes_encrypt gives in GCM mode (a random 12-byte nonce, ciphertext and tag). Reading
passes on what does not have that form, and marks what has it but fails its tag.
"""

from __future__ import annotations

import hmac

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.core import col, let

PREFIX, FAILED = "v1:", "[DECRYPTION_FAILED]"


def encrypt(value: Column | str, key: Column) -> Column:
    """Null stays null, an empty text stays empty."""
    v = col(value)
    return F.when(v.isNull() | (v == ""), v).otherwise(F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(v, key, F.lit("GCM")))))


def is_encrypted(value: Column | str) -> Column:
    return F.coalesce(col(value).rlike(r"^v1:[A-Za-z0-9+/\s]{38,}={0,2}$"), F.lit(False))


def decrypt(value: Column | str, key: Column) -> Column:
    v = col(value)
    plain = F.try_aes_decrypt(F.unbase64(F.when(is_encrypted(v), F.substring(v, F.lit(4), F.length(v)))), key, F.lit("GCM")).cast("string")
    return F.when(~is_encrypted(v), v).otherwise(F.coalesce(plain, F.lit(FAILED)))


DOTTED = r"^enc:[A-Za-z0-9+/]{16}\.[A-Za-z0-9+/]{22}==\.[A-Za-z0-9+/]*={0,2}$"
COLONS = r"^[A-Za-z0-9+/]{22}==:[A-Za-z0-9+/]{22}==:[A-Za-z0-9+/]*={0,2}$"


def encrypt_dotted(value: Column | str, key: Column) -> Column:
    """The dotted form, with a random nonce; null stays null, an empty text stays empty."""
    v = col(value)
    code = lambda raw, a, n: F.base64(F.substring(raw, a, n))
    parts = lambda raw: F.concat(F.lit("enc:"), code(raw, F.lit(1), F.lit(12)), F.lit("."), code(raw, F.length(raw) - 15, F.lit(16)), F.lit("."), F.regexp_replace(code(raw, F.lit(13), F.length(raw) - 28), r"\s", ""))
    return F.when(v.isNull() | (v == ""), v).otherwise(let(F.aes_encrypt(v, key, F.lit("GCM")), parts))


def decrypt_dotted(value: Column | str, key: Column) -> Column:
    """What has the dotted form is read, or marked if its tag fails; anything else is passed on."""
    v = col(value)
    part = lambda n: F.try_to_binary(F.split_part(F.substring(v, F.lit(5), F.length(v)), F.lit("."), F.lit(n)), F.lit("base64"))
    raw = F.when(v.rlike(DOTTED), F.concat(part(1), part(3), part(2)))
    return F.when(v.rlike(DOTTED), F.coalesce(F.try_aes_decrypt(raw, key, F.lit("GCM")).cast("string"), F.lit(FAILED))).otherwise(v)


class Ghash:
    """The hash of GCM for one key: bits are coefficients of a polynomial, the first byte's highest bit the lowest power."""

    def __init__(self, h: bytes) -> None:
        x, self.shifted = int.from_bytes(h, "big"), []
        for _ in range(128):
            self.shifted.append(x)
            x = (x >> 1) ^ (0xE1 << 120 if x & 1 else 0)

    def __call__(self, *parts: bytes) -> bytes:
        """Of parts, each filled up to whole blocks with zeros."""
        y = 0
        for part in parts:
            for i in range(0, len(part), 16):
                z, y = y ^ int.from_bytes(part[i : i + 16].ljust(16, b"\0"), "big"), 0
                for k in range(128):
                    if z >> (127 - k) & 1:
                        y ^= self.shifted[k]
        return y.to_bytes(16, "big")


def _bits(*parts: bytes) -> bytes:
    return b"".join((8 * len(p)).to_bytes(8, "big") for p in parts)


def counter_blocks(nonce: bytes, size: int, ghash: Ghash) -> bytes:
    """The block that seals the tag, then one block for each 16 bytes of text."""
    first = nonce + b"\0\0\0\1" if len(nonce) == 12 else ghash(nonce, _bits(b"", nonce))
    count = int.from_bytes(first[12:], "big")
    return b"".join(first[:12] + ((count + i) % (1 << 32)).to_bytes(4, "big") for i in range(1 - (-size // 16)))


def sealed(text: bytes, stream: bytes, ghash: Ghash, more: bytes = b"", reading: bool = False) -> tuple[bytes, bytes]:
    """(text or ciphertext, tag) from the encrypted counter blocks; `more` is covered by the tag alone."""
    other = (int.from_bytes(text, "big") ^ int.from_bytes(stream[16 : 16 + len(text)], "big")).to_bytes(len(text), "big")
    coded = text if reading else other
    tag = int.from_bytes(ghash(more, coded, _bits(more, coded)), "big") ^ int.from_bytes(stream[:16], "big")
    return other, tag.to_bytes(16, "big")


def _each(run):
    """run(row, hash) for rows without nulls; the keys' hashes are made once for a batch."""

    def batch(*columns: pa.Array) -> pa.Array:
        made: dict[bytes, Ghash] = {}
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        out = []
        for r in rows:
            if None not in r and r[0] not in made:
                made[r[0]] = Ghash(r[0])
            out.append(None if None in r else run(made[r[0]], *r[1:]))
        return pa.array(out, pa.binary())

    return F.arrow_udf(batch, T.BinaryType())


_counters = _each(lambda ghash, nonce, text: counter_blocks(nonce, len(text), ghash))
_written = _each(lambda ghash, text, stream: b"".join(reversed(sealed(text, stream, ghash))))


def _opened(ghash: Ghash, coded: bytes, stream: bytes, tag: bytes) -> bytes | None:
    text, own = sealed(coded, stream, ghash, reading=True)
    return text if hmac.compare_digest(own, tag) else None


_read = _each(_opened)


def _stream(key: Column, nonce: Column, text: Column) -> tuple[Column, Column]:
    """Hash key, and the encrypted counter blocks (ECB puts one more block behind them)."""
    h = F.substring(F.aes_encrypt(F.lit(b"\0" * 16), key, F.lit("ECB")), 1, 16)
    return h, F.aes_encrypt(_counters(h, nonce, text), key, F.lit("ECB"))


def encrypt_colons(value: Column | str, key: Column, nonce: Column) -> Column:
    """The form with colons and a nonce of any length, which must be new for each text; null stays null, an empty text stays empty."""
    v = col(value)
    h, stream = _stream(key, nonce, v.cast("binary"))
    raw = _written(h, v.cast("binary"), stream)
    code = lambda x: F.regexp_replace(F.base64(x), r"\s", "")
    return F.when(v.isNull() | (v == ""), v).otherwise(F.concat_ws(":", code(nonce), code(F.substring(raw, 1, 16)), code(F.substr(raw, F.lit(17)))))


def decrypt_colons(value: Column | str, key: Column) -> Column:
    """What has the form with colons and a nonce of 16 bytes is read, or marked if its tag fails; anything else is passed on."""
    v = col(value)
    part = lambda n: F.when(v.rlike(COLONS), F.try_to_binary(F.split_part(v, F.lit(":"), F.lit(n)), F.lit("base64")))
    h, stream = _stream(key, part(1), part(3))
    return F.when(v.rlike(COLONS), F.coalesce(_read(h, part(3), stream, part(2)).cast("string"), F.lit(FAILED))).otherwise(v)


def read_any(value: Column | str, key: Column) -> Column:
    """A value of any of the three forms, or as it is."""
    v = col(value)
    return F.when(v.rlike(DOTTED), decrypt_dotted(v, key)).when(v.rlike(COLONS), decrypt_colons(v, key)).otherwise(decrypt(v, key))


def encrypt_json(value: Column | str, key: Column) -> Column:
    return encrypt(F.to_json(col(value)), key)


def decrypt_json(value: Column | str, key: Column, schema: str) -> Column:
    """What cannot be decrypted or parsed is null."""
    return F.from_json(decrypt(value, key), schema)


def encrypt_fields(df: DataFrame, fields: list[str], key: Column) -> DataFrame:
    return df.withColumns({f: encrypt(f, key) for f in fields})


def decrypt_fields(df: DataFrame, fields: list[str], key: Column) -> DataFrame:
    return df.withColumns({f: decrypt(f, key) for f in fields})


def probe(df: DataFrame, field: str) -> DataFrame:
    """no_data, active (all values encrypted) or partial; nulls and empty texts are no values."""
    v = F.nullif(F.col(f"`{field}`"), F.lit(""))
    return df.agg(F.when(F.count(v) == 0, "no_data").when(F.bool_and(F.when(v.isNotNull(), is_encrypted(v))), "active").otherwise("partial").alias("verdict"))


def _xored(key: bytes, pad: int) -> bytes:
    return bytes(b ^ pad for b in key.ljust(64, b"\0"))


def hmac_sha256(message: Column | str, key: str) -> Column:
    """Hex signature; nested hashes over the padded key, all built in."""
    import hashlib

    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    inner = F.sha2(F.concat(F.lit(_xored(raw, 0x36)), col(message).cast("binary")), 256)
    return F.sha2(F.concat(F.lit(_xored(raw, 0x5C)), F.unhex(inner)), 256)


def verified(message: Column, signature: Column, sent: Column, now: Column, key: str, old: int = 30, early: int = 5) -> Column:
    """Whether a signature fits and its time, in seconds, is fresh."""
    return (hmac_sha256(message, key) == signature) & (now - sent <= old) & (sent - now <= early)
