"""Display forms of payloads: media type by name, hex dump, indented JSON and XML, CSV rows, durations."""

from __future__ import annotations

import csv
import io
import json
from xml.dom import minidom
from xml.parsers.expat import ExpatError

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Media types by file extension.
TYPES = {
    "css": "text/css; charset=utf-8",
    "csv": "text/csv; charset=utf-8",
    "gif": "image/gif",
    "htm": "text/html; charset=utf-8",
    "html": "text/html; charset=utf-8",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "js": "text/javascript; charset=utf-8",
    "json": "application/json",
    "pdf": "application/pdf",
    "png": "image/png",
    "svg": "image/svg+xml",
    "txt": "text/plain; charset=utf-8",
    "webp": "image/webp",
    "xml": "text/xml; charset=utf-8",
}


def media_type(name: Column, stated: Column | None = None) -> Column:
    """The stated type if there is one, else by the name's extension, else ''."""
    known = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    last = F.substring_index(name, "/", -1)
    ext = F.when(F.instr(last, ".") > 0, F.lower(F.substring_index(last, ".", -1))).otherwise("")
    guess = F.coalesce(F.try_element_at(known, ext), F.lit(""))
    return guess if stated is None else F.when(F.coalesce(stated, F.lit("")) != "", stated).otherwise(guess)


def hex_dump(payload: Column) -> Column:
    """Lines of 16 bytes: offset, hex in two halves, printable characters; '' for an empty payload."""

    def line(i: Column) -> Column:
        part = F.substring(payload, i * 16 + 1, F.lit(16))
        half = lambda at: F.rpad(F.regexp_replace(F.lower(F.hex(F.substring(part, at, 8))), "(..)", "$1 "), 24, " ")
        shown = F.regexp_replace(F.decode(part, "ISO-8859-1"), "[^ -~]", ".")
        return F.concat(F.lpad(F.lower(F.hex(i.cast("long") * 16)), 8, "0"), F.lit("  "), half(1), F.lit(" "), half(9), F.lit(" |"), shown, F.lit("|"))

    n = F.ceil(F.octet_length(payload) / 16).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), line), "\n")).when(n == 0, "")


def _each(values: pd.Series, f) -> pd.Series:
    return pd.Series([None if v is None else f(v) for v in values], dtype=object)


def _json(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def _xml(text: str) -> str | None:
    try:
        return minidom.parseString(text.encode()).toprettyxml(indent="  ")
    except ExpatError:
        return None


def _csv(text: str) -> list[str] | None:
    try:
        return [json.dumps(r, ensure_ascii=False) for r in csv.reader(io.StringIO(text), strict=True)]
    except csv.Error:
        return None


@F.pandas_udf(StringType())
def json_preview(text: pd.Series) -> pd.Series:
    """The document indented by two; null when it is not JSON."""
    return _each(text, _json)


@F.pandas_udf(StringType())
def xml_preview(text: pd.Series) -> pd.Series:
    """The document indented by two; null when it is not well formed."""
    return _each(text, _xml)


@F.pandas_udf(ArrayType(StringType()))
def csv_preview(text: pd.Series) -> pd.Series:
    """Every row as a JSON list of its cells; null when quoting is broken."""
    return _each(text, _csv)


def encoded_name(ident: Column) -> Column:
    """An identifier as a file name."""
    return F.translate(ident, "/+", "_-")


def uptime(seconds: Column) -> Column:
    """5d2h0m, 3h17m, 4m2s, 42s; the sign is dropped."""
    t = F.abs(seconds)
    d, h, m, s = F.floor(t / 86400), F.floor(t / 3600) % 24, F.floor(t / 60) % 60, t % 60
    show = lambda *parts: F.concat(*[F.concat(v.cast("string"), F.lit(unit)) for v, unit in parts])
    return F.when(t >= 86400, show((d, "d"), (h, "h"), (m, "m"))).when(t >= 3600, show((h, "h"), (m, "m"))).when(t >= 60, show((m, "m"), (s, "s"))).otherwise(show((s, "s")))


def checkpoint_id(moment: Column) -> Column:
    """A fixed-width identifier that sorts by time, to the nanosecond (Spark has microseconds)."""
    return F.concat(F.date_format(moment, "yyyyMMdd'T'HHmmss.SSSSSS"), F.lit("000Z"))
