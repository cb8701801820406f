"""Payload transforms: zstd and sealed segments, with identities taken at every stage."""

from __future__ import annotations

import hashlib
import hmac
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

SEGMENT = 65536


@F.pandas_udf(BinaryType())
def compress(payload: pd.Series) -> pd.Series:
    import zstandard

    coder = zstandard.ZstdCompressor(level=3)
    return payload.map(lambda b: None if b is None else coder.compress(b))


@F.pandas_udf(BinaryType())
def decompress(payload: pd.Series) -> pd.Series:
    """Null for what is not a whole frame."""
    import zstandard

    coder = zstandard.ZstdDecompressor()

    def one(b: bytes | None) -> bytes | None:
        try:
            return None if b is None else coder.decompress(b)
        except zstandard.ZstdError:
            return None

    return payload.map(one)


def convergent_iv(key: bytes, key_id: str):
    """A UDF (payload hash hex, segment index) -> 12-byte IV: equal plaintexts seal to equal bytes."""

    @F.pandas_udf(BinaryType())
    def iv(digest: pd.Series, index: pd.Series) -> pd.Series:
        return pd.Series([hmac.new(key, bytes.fromhex(d) + key_id.encode() + struct.pack(">Q", int(i)), hashlib.sha256).digest()[:12] for d, i in zip(digest, index, strict=True)])

    return iv


def validate(stages: list[str]) -> None:
    """Only known stages, and a cipher only as the last one."""
    known = {"zstd", "aes-gcm"}
    if unknown := [s for s in stages if s not in known]:
        raise ValueError(f"unknown stage {unknown[0]}")
    if "aes-gcm" in stages[:-1]:
        raise ValueError("a cipher must be the last stage")


def segments(payload: Column, size: int = SEGMENT) -> Column:
    """Array of (index, part) of a binary payload; an empty payload is one empty segment."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("index"), F.substring(payload, i * size + 1, F.lit(size)).alias("part")))


def seal(part: Column, key: Column, iv: Column, aad: Column) -> Column:
    return F.aes_encrypt(part, key, F.lit("GCM"), F.lit("DEFAULT"), iv, aad)


def unseal(frame: Column, key: Column, aad: Column) -> Column:
    """Null when the frame was tampered with."""
    return F.try_aes_decrypt(frame, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def fragment(payload: Column, start: int, end: int) -> Column:
    """Bytes [start, end); null out of bounds."""
    ok = (F.lit(start) >= 0) & (F.lit(end) > start) & (F.octet_length(payload) >= end)
    return F.when(ok, F.substring(payload, start + 1, end - start))


def fragment_error(payload: Column, start: int, end: int) -> Column:
    """Why a fragment cannot be cut: a negative start, an end not after it, an end beyond the payload; null when it can."""
    return F.when(F.lit(start < 0), "negative_start").when(F.lit(end <= start), "empty_range").when(F.octet_length(payload) < end, "beyond_end")


#: What each stage does to a payload, and back.
STAGES = {"zstd": (compress, decompress), "hex": (lambda c: F.encode(F.hex(c), "utf-8"), lambda c: F.unhex(F.decode(c, "utf-8"))), "base64": (lambda c: F.encode(F.translate(F.base64(c), "\r\n", ""), "utf-8"), lambda c: F.unbase64(F.decode(c, "utf-8")))}


def run_stages(rows: DataFrame, stages: list[str], payload: str = "payload") -> DataFrame:
    """Adds what the stages make of the payload: stored, content_hash (input), hashes (after each stage) and blob_ref (of what is stored)."""
    if unknown := [s for s in stages if s not in STAGES]:
        raise ValueError(f"unknown stage {unknown[0]}")
    out, hashes = rows.withColumn("content_hash", F.sha2(payload, 256)).withColumn("stored", F.col(payload)), []
    for k, name in enumerate(stages):
        out = out.withColumn("stored", STAGES[name][0](F.col("stored"))).withColumn(f"__h{k}", F.sha2("stored", 256))
        hashes.append(F.col(f"__h{k}"))
    out = out.withColumn("hashes", F.array(*hashes).cast("array<string>")).withColumn("blob_ref", F.element_at("hashes", -1) if stages else F.col("content_hash"))
    return out.drop(*[f"__h{k}" for k in range(len(stages))])


def undo_stages(rows: DataFrame, stages: list[str], stored: str = "stored") -> DataFrame:
    """Adds the payload that the stages, undone in reverse order, give; null when one of them cannot read it.  Unknown stages are passed over."""
    out = rows.withColumn("payload", F.col(stored))
    for name in reversed([s for s in stages if s in STAGES]):
        out = out.withColumn("payload", STAGES[name][1](F.col("payload")))
    return out


#: First bytes of a sealed payload: a magic, a version and the segment size.
MAGIC = b"TDMK\x01"


def sealed_frames(frames: Column, size: int = SEGMENT) -> Column:
    """The sealed payload as bytes: header, then each frame (struct of iv and sealed) as 12 bytes of iv, 4 of length and the sealed bytes."""
    one = lambda f: F.concat(f["iv"], F.unhex(F.lpad(F.hex(F.octet_length(f["sealed"])), 8, "0")), f["sealed"])
    return F.concat(F.lit(MAGIC + struct.pack(">I", size)), F.aggregate(F.transform(frames, one), F.lit(b""), lambda a, x: F.concat(a, x)))


@F.pandas_udf(ArrayType(StructType([StructField("iv", BinaryType()), StructField("sealed", BinaryType())])))
def parsed_frames(payload: pd.Series) -> pd.Series:
    """The frames of a sealed payload; null when it has another header or ends inside a frame."""

    def one(raw: bytes | None):
        if raw is None or raw[: len(MAGIC)] != MAGIC:
            return None
        at, out = len(MAGIC) + 4, []
        while at < len(raw):
            if at + 16 > len(raw):
                return None
            n = struct.unpack(">I", raw[at + 12 : at + 16])[0]
            if at + 16 + n > len(raw):
                return None
            out.append({"iv": raw[at : at + 12], "sealed": raw[at + 16 : at + 16 + n]})
            at += 16 + n
        return out

    return pd.Series([one(b) for b in payload], dtype=object)
