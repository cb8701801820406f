"""Column functions: identities, paths, metadata documents, display forms."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Domain separation of handles, and the document of an artifact without identity fields; our own constants.
HANDLE_KEY, IDENTITY = "tidemark/handle/1:", "tidemark/identity/1:{}"


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def identity_hash(document: Column | None = None) -> Column:
    """The hash of the identity fields' document, as ``sha256-<hex>``; without fields a constant."""
    return F.concat(F.lit("sha256-"), F.sha2(F.lit(IDENTITY) if document is None else document, 256))


def handle(content: Column, nonce: Column | None = None, meta: Column | None = None, key: str = HANDLE_KEY) -> Column:
    """``sha256-<hex>`` of the bytes key, content hash, identity hash and nonce: equal content gives equal handles unless a nonce sets them apart."""
    parts = [F.lit(key.encode()), F.unhex(content), F.unhex(hash_part(identity_hash() if meta is None else meta))] + ([nonce] if nonce is not None else [])
    return F.concat(F.lit("sha256-"), F.sha2(F.concat(*parts), 256))


def parsed_id(ident: Column) -> Column:
    """struct(algorithm, raw) of ``<algorithm>-<hex>``; null for what is not one."""
    return F.when(ident.rlike("^[a-z0-9]+-([0-9a-f]{2})+$"), F.struct(F.substring_index(ident, "-", 1).alias("algorithm"), F.unhex(hash_part(ident)).alias("raw")))


def manifest_document(ext: str, artifact: str, refs: str, content: str, created: str, size: str, session: str) -> Column:
    """The canonical document of a manifest: keys in order, no white space.  Its hash is the manifest's digest."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.col(refs), lambda r: F.concat(F.lit('"'), r, F.lit('"'))), ","), F.lit("]"))
    layout = F.when(F.size(refs) > 0, F.lit('"Target"')).otherwise(F.lit('"Inline"'))
    return F.concat(
        F.lit('{"ext":'), F.col(ext), F.lit(',"sys":{"artifact_id":'), quoted(artifact), F.lit(',"blob_refs":'), listed, F.lit(',"content_hash":'), quoted(content), F.lit(',"created_at":"'), rfc3339(F.col(created)),
        F.lit('","layout_header":{"blob_storage":'), layout, F.lit('},"original_size":'), F.col(size).cast("string"), F.lit(',"schema_version":1,"session_id":'), quoted(session), F.lit("}}"),
    )


#: What a manifest document holds; unknown fields are refused by ``strict_manifest``.
MANIFEST = "ext string, sys struct<artifact_id: string, blob_refs: array<string>, content_hash: string, created_at: string, layout_header: struct<blob_storage: string>, original_size: bigint, schema_version: int, session_id: string>"


def parsed_manifest(document: Column) -> Column:
    """The document's fields with ext as text; null when it is not a manifest or has fields that manifests do not have."""
    sys_fields = F.array(*[F.lit(x) for x in ("artifact_id", "blob_refs", "content_hash", "created_at", "layout_header", "original_size", "schema_version", "session_id")])
    known = (F.size(F.array_except(F.json_object_keys(document), F.array(F.lit("ext"), F.lit("sys")))) == 0) & (F.size(F.array_except(F.json_object_keys(F.get_json_object(document, "$.sys")), sys_fields)) == 0)
    return F.when(F.coalesce(known, F.lit(False)), F.from_json(document, MANIFEST))


def hash_part(ident: Column) -> Column:
    """What follows the first dash of an identifier; the whole of it without one."""
    return F.regexp_replace(ident, "^[^-]*-", "")


def crypto_identity(pipeline: Column) -> Column:
    """The last cipher stage as ``algorithm/key``, '' for plain payloads."""
    ciphers = F.filter(pipeline, lambda s: F.lower(s["algorithm"]).isin("aes-gcm", "chacha20-poly1305"))
    return F.coalesce(F.concat(F.lower(F.try_element_at(ciphers, F.lit(-1))["algorithm"]), F.lit("/"), F.try_element_at(ciphers, F.lit(-1))["key_id"]), F.lit(""))


def shard(ident: Column) -> Column:
    """``aa/bb/id`` by the first hex digits, ``_short/id`` if there are fewer than four."""
    h = hash_part(ident)
    return F.when(F.length(h) < 4, F.concat(F.lit("_short/"), ident)).otherwise(F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), ident))


def ref_shaped(ref: Column) -> Column:
    return ref.rlike("^[0-9a-f]{4,}$")


def blob_path(ref: Column, root: str = "blobs", sharded: bool = True) -> Column:
    return F.concat_ws("/", F.lit(root), *([F.substring(ref, 1, 2), F.substring(ref, 3, 2)] if sharded else []), ref)


def path_ref(path: Column) -> Column:
    """The reference a path ends in, null when it is not shaped like one."""
    last = F.substring_index(path, "/", -1)
    return F.when(ref_shaped(last), last)


def valid_path(path: Column) -> Column:
    return (path != "") & (F.instr(path, "\0") == 0) & F.forall(F.split(path, "/"), lambda s: ~s.isin("", ".", ".."))


def is_under(path: Column, prefix: str) -> Column:
    """The prefix itself or below it; '' holds every path but the empty one."""
    return path != "" if prefix == "" else (path == prefix) | path.startswith(prefix + "/")


def is_strict_under(path: Column, prefix: str) -> Column:
    return path != "" if prefix == "" else path.startswith(prefix + "/")


def split_first(path: Column) -> Column:
    """struct(first, rest): what is before and after the first slash."""
    at = F.instr(path, "/")
    return F.when(at > 0, F.struct(F.substring(path, F.lit(1), at - 1).alias("first"), F.substring(path, at + 1, F.length(path)).alias("rest"))).otherwise(F.struct(path.alias("first"), F.lit("").alias("rest")))


def join_path(parent_path: Column, child: Column) -> Column:
    return F.when(parent_path == "", child).when(child == "", parent_path).otherwise(F.concat(parent_path, F.lit("/"), child))


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def vfs_status(ext: Column) -> Column:
    """absent / ok / error for the path document inside ext: not an object or another version is absent, a bad path is an error."""
    doc = F.get_json_object(ext, "$.vfsmeta")
    version, path = F.get_json_object(ext, "$.vfsmeta.version"), F.get_json_object(ext, "$.vfsmeta.path")
    return F.when(doc.isNull() | F.coalesce(version != "1", F.lit(True)), "absent").when(F.coalesce(valid_path(path), F.lit(False)), "ok").otherwise("error")


def vfs_path(ext: Column) -> Column:
    return F.when(vfs_status(ext) == "ok", F.get_json_object(ext, "$.vfsmeta.path"))


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_path(seconds: Column, label: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy/MM/dd/HH-mm-ss-"), label)


def human_bytes(n: Column) -> Column:
    """Bytes with one decimal in KiB to TiB, plain below 1024; the sign is dropped."""
    size = F.abs(n)
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(size >= 1024**power, F.concat(F.format_string("%.1f", F.bround(size / F.lit(float(1024**power)), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def parsed_rfc3339(text: Column) -> Column:
    """Seconds of an RFC 3339 moment with any offset; '' and null are no moment, and neither is anything malformed."""
    ok = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")
    return F.when(ok, F.unix_seconds(F.try_to_timestamp(text)))


@F.pandas_udf(StringType())
def merged_ext(ext: pd.Series, key: pd.Series, value: pd.Series) -> pd.Series:
    """The document with one key set to a JSON value, keys in order, others kept with their types; null if it is not an object."""

    def one(text: str | None, k: str, v: str) -> str | None:
        try:
            doc = json.loads(text) if text else {}
        except ValueError:
            return None
        return json.dumps({**doc, k: json.loads(v)}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if isinstance(doc, dict) else None

    return pd.Series([one(*row) for row in zip(ext, key, value, strict=True)], dtype=object)


def ext_keys(ext: Column) -> Column:
    """Sorted keys of the document; none when it is not an object."""
    return F.sort_array(F.coalesce(F.json_object_keys(ext), F.array().cast("array<string>")))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.format_string("%.2fx", a / b)).otherwise("")
