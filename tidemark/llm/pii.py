"""Personal data: plain identifiers, and disguised ones found through offset-preserving transducers.

The base patterns run on the text as it is.  Then transducers rewrite disguises
(look-alike letters, digits of any script, zero-width characters, spelled digits,
written-out "at" and "dot", the words in English, German, French and Spanish) while recording which source characters every rewritten character
stands for; the same detectors run on the rewritten text and what they find maps back
to source characters.  A mapped span is added unless it overlaps a base span.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sha256_hex, small_batches, tidied

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its start only and never given back, so long runs are scanned once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

#: Letters of other scripts that are confusable with a Latin letter, by that letter.
CONFUSABLE = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲᴄⅽ", "d": "ԁɗⅾ", "e": "еҽ", "f": "ϝſ", "g": "ɡցƍ", "h": "һհ", "i": "іıɩι", "j": "јϳ", "k": "κк", "l": "ӏⅼ", "m": "ⅿ", "n": "ոռ", "o": "оοօσ",
    "p": "рρ", "q": "ԛգ", "r": "гᴦ", "s": "ѕʂ", "t": "τт", "u": "υսʋ", "v": "νѵᴠ", "w": "ԝѡᴡ", "x": "хχ", "y": "уγү", "z": "ᴢʐ",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫͿ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ",
    "Q": "Ԛ", "R": "ᎡᏒ", "S": "ЅᏚՏ", "T": "ТΤᎢ", "U": "Սሀ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ΥҮ", "Z": "ΖᏃ", "-": "‐‑‒–−﹘", ".": "․。٠۔", "@": "＠﹫",
}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@.+-_() ")


def _foreign() -> dict[str, str]:
    """What stands for each look-alike: digits of any script, compatibility forms of one plain character, small capitals, confusables."""
    out = {c: "" for c in INVISIBLE}
    for k in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x10400, 0x1FC00)):
        c = chr(k)
        digit = unicodedata.digit(c, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain in PLAIN:
            out[c] = plain
        elif (name := unicodedata.name(c, "")).startswith("LATIN LETTER SMALL CAPITAL ") and len(name) == 28:
            out[c] = name[-1].lower()
    return {c: plain for plain, own in CONFUSABLE.items() for c in own} | out


LOOKALIKES = _foreign()
#: Two patterns, as one of both would be much slower.
FOREIGN, BEYOND = re.compile("[" + "".join(c for c in LOOKALIKES if c < "\U00010000") + "]"), re.compile("[\U00010400-\U0001fbff]")
#: Digit words of the languages of the table: English, German, French, Spanish; "une" is an article only.
WORDS = (
    ("zero", "oh", "null", "zéro", "cero"), ("one", "eins", "un", "uno"), ("two", "zwei", "zwo", "deux", "dos"), ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "fuenf", "cinq", "cinco"), ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"), ("nine", "neun", "neuf", "nueve"),
)
#: Accents may come as one character or as a letter and a mark.
SPELLED = {unicodedata.normalize(form, w): str(d) for d, words in enumerate(WORDS) for w in words for form in ("NFC", "NFD")}
#: A letter of any script: digit words stand alone.
LETTER = r"[^\W\d_]"
NUMBER = rf"(?:{'|'.join(SPELLED)})(?!{LETTER})"
OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
DOTS = "dot|point|punkt|punto"
WRITTEN_DOT = rf"\s*{OPEN}\s*(?:{DOTS}|\.)\s*{CLOSE}\s*|\s+(?:{DOTS})\s+|\s?\.\s?"
PLUS = r"(?:plus|más|mas)[\s-]+|\+\s?"
ITEM = rf"(?:{NUMBER}|[0-9]+)"
#: Digits and spelled digits with separators and written dots between them; one alone only after a plus.
SPELLED_RUN = re.compile(rf"(?<!{LETTER})(?:(?<![0-9])|(?<=[a-z][0-9]))(?:(?:{PLUS}){ITEM}(?:(?:{WRITTEN_DOT}|[\s,()-]+){ITEM})*|{ITEM}(?:(?:{WRITTEN_DOT}|[\s,()-]+){ITEM})+)")
TOKEN = re.compile(rf"(?P<num>{NUMBER})|(?P<dot>{WRITTEN_DOT})|(?P<plus>{PLUS})|(?P<dig>[0-9]+)|(?P<sep>[\s,()-]+)")
#: White space taken from its start only, so a long run of it is scanned once.
GAP = r"(?<!\s)\s++"
#: Without brackets a written "at" needs a written dot, and one that its language does not use for other things: "at this
#: point in" is prose, and so is "look at example.com".
NAME = r"[a-z0-9-]++"
SHUT = rf"\s*{OPEN}\s*(?:{DOTS}|\.)\s*{CLOSE}\s*"
AT = re.compile(
    rf"(?:{GAP})?{OPEN}\s*(?:at|ät|@|arroba|arr?obase|klammeraffe)\s*{CLOSE}\s*"
    rf"|{GAP}(?:at|ät|klammeraffe)\s+(?={NAME}(?:\s+(?:dot|punkt)\s+|{SHUT})[a-z0-9])"
    rf"|{GAP}(?:arroba|arr?obase)\s+(?={NAME}(?:\s+(?:{DOTS})\s+|{SHUT})[a-z0-9])"
    rf"|{GAP}@\s+(?=[a-z0-9])"
)
DOT = re.compile(rf"(?:{GAP})?{OPEN}\s*(?:{DOTS}|\.)\s*{CLOSE}\s*|{GAP}(?:{DOTS})\s+(?=[a-z0-9])")
#: Top-level domains of more than two letters that an address read out of a disguise may end in.
DOMAINS = frozenset("com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post app dev cloud online site shop store blog xyz tech space club live news email agency berlin paris test example invalid local".split())


def plausible(address: str) -> bool:
    """Whether an address found by rewriting ends like one: a country's two letters or a known domain, in one case."""
    last = address.rpartition(".")[2]
    return last.isalpha() and (last.islower() or last.isupper()) and (len(last) == 2 or last.lower() in DOMAINS)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, linear in the text: a local part never holds an @, so each @ is tried once."""
    done, k = 0, text.find("@")
    while k >= 0:
        s = k
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        if s < k and (m := DOMAIN.match(text, k + 1)):
            yield s, m.end()
            done = m.end()
        k = text.find("@", max(k + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def detect(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, as KINDS."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    if "@" in text:
        out[0] = list(emails(text))
    if DIGIT.search(text):
        if text.count(".") >= 3:
            out[1] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out[2].append(m.span())
        if "+" in text:
            out[3] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


Edit = tuple[int, int, str]


class Rewritten:
    """A text after edits, with the source span of every rewritten character."""

    def __init__(self, text: str, edits: list[Edit]):
        parts, self.starts, self.origin, at, n = [], [0], [(0, 0, True)], 0, 0
        for s, e, new in edits:
            if s < at:
                continue  # an earlier edit covers it
            if s > at:
                parts.append(text[at:s])
                self._piece(n, at, s, True)
                n += s - at
            parts.append(new)
            if new:
                self._piece(n, s, e, False)
            n += len(new)
            at = e
        parts.append(text[at:])
        self._piece(n, at, len(text), True)
        self.text = "".join(parts)

    def _piece(self, n: int, s: int, e: int, same: bool) -> None:
        self.starts.append(n)
        self.origin.append((s, e, same))

    def source(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        s, _, same = self.origin[i]
        a = s + start - self.starts[i] if same else s
        s, e, same = self.origin[j]
        return a, s + end - self.starts[j] if same else e


def glyphs(text: str) -> list[Edit]:
    found = list(FOREIGN.finditer(text))
    if BEYOND.search(text):
        found = sorted([*found, *BEYOND.finditer(text)], key=lambda m: m.start())
    return [(m.start(), m.end(), new) for m in found if (new := LOOKALIKES.get(m[0])) is not None]


def spelled(low: str) -> tuple[list[Edit], list[Edit]]:
    """Edits of every run that holds a spelled digit: without any separators, and with those between two groups of plain digits left."""
    joined, apart = [], []
    for m in SPELLED_RUN.finditer(low):
        tokens = list(TOKEN.finditer(low, m.start(), m.end()))
        if all(t.lastgroup != "num" for t in tokens):
            continue
        for k, t in enumerate(tokens):
            if t.lastgroup != "dig":
                edit = (t.start(), t.end(), {"num": SPELLED.get(t[0], ""), "dot": ".", "plus": "+", "sep": ""}[t.lastgroup])
                joined.append(edit)
                if t.lastgroup != "sep" or tokens[k - 1].lastgroup == "num" or tokens[k + 1].lastgroup == "num":
                    apart.append(edit)
    return joined, apart


def disguises(low: str) -> list[Edit]:
    return sorted([(m.start(), m.end(), "@") for m in AT.finditer(low)] + [(m.start(), m.end(), ".") for m in DOT.finditer(low)])


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _found(now: str, steps: list[Rewritten]) -> list[list[tuple[int, int]]]:
    """What the detectors find once written-out signs are rewritten too, in source characters."""
    low = _lower(now)
    if ("dot" in low or "point" in low or "punkt" in low or "punto" in low or "@" in low or "arroba" in low or "obase" in low or "at" in low and "." in low or "ät" in low or "klammeraffe" in low) and (edits := disguises(low)):
        steps = [*steps, Rewritten(now, edits)]
        now = steps[-1].text
    if not steps:
        return [[], [], [], []]
    found = detect(now)
    found[0] = [(s, e) for s, e in found[0] if plausible(now[s:e])]
    for step in reversed(steps):
        found = [[step.source(s, e) for s, e in spans] for spans in found]
    return found


def disguised(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind that show only after the transducers, in source characters.

    A run with spelled digits is read as it is, joined, and with plain groups left apart; where the
    readings overlap the longest span holds.
    """
    steps: list[Rewritten] = []
    now = text
    if not now.isascii() and (edits := glyphs(now)):
        steps.append(Rewritten(now, edits))
        now = steps[-1].text
    found = _found(now, steps)
    joined, apart = spelled(_lower(now))
    if not joined:
        return found
    readings = [found]
    for edits in (joined, apart) if apart != joined else (joined,):
        step = Rewritten(now, edits)
        readings.append(_found(step.text, [*steps, step]))
    out = []
    for kind in zip(*readings, strict=True):
        best: list[tuple[int, int]] = []
        for s, e in sorted({x for spans in kind for x in spans}, key=lambda x: (x[0] - x[1], x)):
            i = bisect_left(best, (s, e))
            if (i == 0 or best[i - 1][1] <= s) and (i == len(best) or best[i][0] >= e):
                best.insert(i, (s, e))
        out.append(best)
    return out


def spans(text: str) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """(base spans, spans the method adds) of each kind."""
    base, more = detect(text), disguised(text)
    out: list[list[tuple[int, int]]] = []
    taken: list[list[int]] = []  # base spans of all kinds, joined where they overlap
    for s, e in sorted(x for kind in base for x in kind):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    starts = [s for s, _ in taken]
    for kind in more:
        out.append([(s, e) for s, e in sorted(set(kind)) if not ((i := bisect_left(starts, e)) and taken[i - 1][1] > s)])
    return base, out


def listed(per_kind: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, found in zip(KINDS, per_kind, strict=True) for s, e in sorted(found))


def personal_data(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, kind:start:end), n_added.

    Offsets are code points, ends exclusive.  Null and empty texts have no spans; rows repeat as they come.
    """
    src = docs.select(*carry, docs[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) + ", " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows = batch.schema.names[:-1], []
            for value in batch.column(len(names)):
                base, more = spans(value.as_py() or "")
                rows.append((*map(len, base), sha256_hex(listed(base).encode()), listed([b + m for b, m in zip(base, more, strict=True)]), sum(map(len, more))))
            found = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            cols = [batch.column(i) for i in range(len(names))] + [pa.array(list(c), k) for c, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    small_batches(docs.sparkSession)
    return src.mapInArrow(tidied(run), schema)


def mask(text: str) -> str:
    """The text with every span replaced by the name of its kind; overlapping spans become one."""
    base, more = spans(text)
    found = sorted((s, e, k) for k, b, m in zip(KINDS, base, more, strict=True) for s, e in b + m)
    if not found:
        return text
    out, at, i = [], 0, 0
    while i < len(found):
        s, e, kind = found[i]
        i += 1
        while i < len(found) and found[i][0] < e:
            e = max(e, found[i][1])
            i += 1
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with personal data masked; other columns as they came, the length column kept true.

    A null text stays null.
    """
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([None if (v := x.as_py()) is None else mask(v) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(len(names))], schema=batch.schema)

    small_batches(docs.sparkSession)
    out = docs.mapInArrow(tidied(run), docs.schema)
    if length in names:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.length(text)).cast(kind))
    return out
