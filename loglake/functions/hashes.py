"""Checksums and hashes that Spark lacks: CRC-32C and FNV-1a over Arrow batches, HMAC, tokens."""

import base64
import hashlib
import hmac
import json
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DecimalType, LongType

#: The Castagnoli polynomial (reflected), FNV-1a's offset basis and prime.
CRC32C_POLY = 0x82F63B78
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CRC32C_POLY), t >> 1).astype(np.uint32)
    return t


_TABLE = _table()


def _columns(values: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values as one byte array with starts and lengths, so that each step handles one byte of every value."""
    raw = [b"" if v is None else bytes(v) for v in values]
    size = np.array([len(r) for r in raw], np.int64)
    return np.frombuffer(b"".join(raw) or b"\0", np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size


def crc32c_array(values: pd.Series, seed: int = 0) -> np.ndarray:
    data, start, size = _columns(values)
    crc = np.full(len(size), ~np.uint32(seed), np.uint32)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        crc[live] = _TABLE[(crc[live] ^ data[start[live] + k]) & 0xFF] ^ (crc[live] >> np.uint32(8))
    return ~crc


def fnv1a_64_array(values: pd.Series) -> np.ndarray:
    data, start, size = _columns(values)
    h = np.full(len(size), FNV_BASIS, np.uint64)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        h[live] = (h[live] ^ data[start[live] + k].astype(np.uint64)) * np.uint64(FNV_PRIME)
    return h


def fnv1a_64_int(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def _crc32c(values: pd.Series) -> pd.Series:
    return pd.Series(crc32c_array(values).astype(np.int64)).where(values.notna().to_numpy())


def _fnv(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else Decimal(int(h)) for v, h in zip(values, fnv1a_64_array(values), strict=True)], dtype=object)


def crc32c(data: Column) -> Column:
    return pandas_udf(_crc32c, LongType())(data.cast("binary"))


def fnv1a_64(data: Column) -> Column:
    """Unsigned, as decimal(20, 0)."""
    return pandas_udf(_fnv, DecimalType(20, 0))(data.cast("binary"))


def hmac_sha256(key: bytes, data: Column) -> Column:
    @pandas_udf("binary")
    def f(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else hmac.new(key, bytes(v), hashlib.sha256).digest() for v in values], dtype=object)

    return f(data.cast("binary"))


def hkdf_sha256(secret: bytes, salt: bytes, info: bytes, size: int = 32) -> bytes:
    """Key derivation for a segment's data key."""
    prk, out, block = hmac.new(salt or b"\0" * 32, secret, hashlib.sha256).digest(), b"", b""
    while len(out) < size:
        block = hmac.new(prk, block + info + bytes([len(out) // 32 + 1]), hashlib.sha256).digest()
        out += block
    return out[:size]


def _part(x: str) -> bytes:
    return base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))


def verify_jwt(token: str | None, key: bytes, now: int, issuer: str | None = None, audience: str | None = None, leeway: int = 0) -> dict:
    """Checks an HS256 token: signature, exp, nbf, iat, iss, aud; returns error (null if good), subject, roles."""
    bad = lambda why: {"error": why, "subject": None, "roles": None}
    try:
        head, body, sign = (token or "").split(".")
        claims, header = json.loads(_part(body)), json.loads(_part(head))
        given = _part(sign)
    except ValueError:
        return bad("malformed")
    if not isinstance(header, dict) or not isinstance(claims, dict) or header.get("alg") != "HS256":
        return bad("algorithm")
    if not hmac.compare_digest(hmac.new(key, f"{head}.{body}".encode(), hashlib.sha256).digest(), given):
        return bad("signature")
    number = lambda n: isinstance(claims.get(n), (int, float))
    if not number("exp") or now > claims["exp"] + leeway:
        return bad("expired")
    if number("nbf") and now < claims["nbf"] - leeway:
        return bad("not_yet_valid")
    if number("iat") and now < claims["iat"] - leeway:
        return bad("issued_later")
    if issuer and claims.get("iss") != issuer:
        return bad("issuer")
    aud = claims.get("aud")
    if audience and audience not in (aud if isinstance(aud, list) else [aud]):
        return bad("audience")
    roles = claims.get("roles") or []
    return {"error": None, "subject": claims.get("sub"), "roles": [str(r) for r in roles] if isinstance(roles, list) else []}


def jwt(token: Column, key: bytes, now: int, **options) -> Column:
    @pandas_udf("error string, subject string, roles array<string>")
    def f(tokens: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([verify_jwt(t, key, now, **options) for t in tokens], columns=["error", "subject", "roles"])

    return f(token)


def register(spark: SparkSession) -> None:
    """Makes crc32c and fnv1a_64 callable from SQL."""
    spark.udf.register("crc32c", pandas_udf(_crc32c, LongType()))
    spark.udf.register("fnv1a_64", pandas_udf(_fnv, DecimalType(20, 0)))


def sha256_hex(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)
