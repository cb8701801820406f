"""Byte-pair encoding in numpy: batched merge rounds over many words at once.

The symbols of all words of a batch lie in one flat array, beside the rank of the
pair that starts at each.  Ranks come from binary search over the sorted pair keys;
after a round only pairs beside a merge are looked up again.  In each round every
word finds its lowest rank, and all occurrences of that pair (left to right, not
overlapping) merge together.

The same rounds serve words of any length.  A word is cut into segments of ``reach``
symbols, and a segment may merge its lowest pair as soon as neither neighbour has a
lower one.  That gives the library's result: a merge elsewhere can only come near by
growing one token, a token has at most ``reach // 2`` bytes, and a whole neighbouring
segment lies between.  So a giant word needs about as many rounds as a segment has
symbols, not one for each merge, and a word of one segment merges its own lowest pair.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import small_batches, tidied

#: Entries, and characters, of the per-process word cache before it is emptied (memory bound, no effect on results).
CACHE, CACHED = 200_000, 1 << 24
#: Texts handled together, in characters.
CHUNK = 1 << 21
#: Rank of a pair that never merges.
NONE = np.int32(0x7FFFFFFF)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + n)
            n += 1
    return [letters[b] for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of one file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.start = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + self.suffix] for x in letters], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        cut = len(self.suffix)
        self.merged = np.array([vocab[a[: len(a) - cut] + b if cut and a.endswith(self.suffix) else a + b] for a, b in pairs], np.int64)
        back = {x: b for b, x in enumerate(letters)}
        n = max(max(vocab.values()), *self.special.values()) + 1
        raw: list[bytes] = [b""] * n
        for token, i in vocab.items():
            body = token[: len(token) - cut] if cut and token.endswith(self.suffix) else token
            raw[i] = bytes(back[c] for c in body) if all(c in back for c in body) else token.encode()
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.token_len = np.array([len(x) for x in raw], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])[:-1]
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        #: Symbols of a segment: more than two tokens hold.
        self.reach = 2 * int(self.token_len[self.merged].max(initial=1)) + 2

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair by binary search, NONE where it never merges."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _ranked(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pairs that start at the places ``at``; NONE at the end of a word."""
        out = np.full(len(at), NONE)
        inside = np.flatnonzero(at < len(sym) - 1)
        inside = inside[owner[at[inside]] == owner[at[inside] + 1]]
        out[inside] = self.lookup(sym[at[inside]], sym[at[inside] + 1])
        return out

    def rounds(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word of each id, ids) of words as they finish; empty words have no ids."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        some = np.flatnonzero(size)
        if not len(some):
            return
        length = size[some]
        sym = self.start[np.frombuffer(b"".join(words), np.uint8)]
        sym[np.cumsum(length) - 1] = self.last[np.fromiter((words[w][-1] for w in some), np.int64, len(some))]
        owner = np.repeat(some, length)
        rank = self._ranked(sym, owner, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            spans = np.diff(np.append(first, len(sym)))
            pieces = -(-spans // self.reach)
            word = np.repeat(np.arange(len(first)), pieces)
            lead = np.cumsum(pieces) - pieces
            cut = first[word] + (np.arange(len(word)) - lead[word]) * self.reach
            own = np.minimum.reduceat(rank, cut)
            low = own.copy()
            near = np.flatnonzero(word[1:] == word[:-1])
            low[near + 1] = np.minimum(low[near + 1], own[near])
            low[near] = np.minimum(low[near], own[near + 1])
            idle = np.minimum.reduceat(own, lead) == NONE
            if idle.any():  # finished words leave the flat array
                out = np.repeat(idle, spans)
                yield owner[out], sym[out]
                busy = ~out
                sym, owner, rank = sym[busy], owner[busy], rank[busy]
                if not len(sym):
                    return
                low = np.repeat(low[~idle[word]], np.diff(np.append(cut, len(out)))[~idle[word]])
            else:
                low = np.repeat(low, np.diff(np.append(cut, len(sym))))
            hit = rank == low
            hit &= low != NONE
            where = np.flatnonzero(hit)
            # of a run of overlapping hits every second one merges, from the left
            fresh = np.ones(len(where), bool)
            fresh[1:] = where[1:] != where[:-1] + 1
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            # a run that goes on to the left of what may merge now has no known start: it waits
            start = where[fresh]
            begun = (start > 0) & (rank[start - 1] == rank[start])
            take = (np.arange(len(where)) - head) % 2 == 0
            if begun.any():
                take &= ~begun[np.cumsum(fresh) - 1]
            where = where[take]
            sym[where] = self.merged[rank[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            at = where - np.arange(len(where))
            rank[at] = self._ranked(sym, owner, at)
            at = at[at > 0] - 1
            rank[at] = self._ranked(sym, owner, at)

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat token ids of all words and the number of ids of each word (empty words have none)."""
        done = list(self.rounds(words))
        if not done:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        owners, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(owners, kind="stable")
        return ids[order], np.bincount(owners, minlength=len(words)).astype(np.int64)

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """How many symbols of each word are left when nothing merges any more."""
        out = np.zeros(len(words), np.int64)
        for owner, _ in self.rounds(words):
            out += np.bincount(owner, minlength=len(words))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_at[ids], self.token_len[ids]).tobytes()


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[start:start+length]`` over all rows."""
    total = int(length.sum())
    if not total:
        return flat[:0]
    base = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return flat[base + np.arange(total)]


@functools.lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


#: Fixed value: the split pattern of byte-level byte-pair vocabularies (given with the public files).
BYTE_LEVEL = regex.compile(public_tokenizers.PATTERN)
#: Fixed value: the split pattern stated in the word vocabulary's file.
WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: Code points (hexadecimal, ranges included) that the regular expressions here know as letters or
#: numbers and the library, with older character tables, does not.
NEW_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
).split()
RANGES = ["-".join(chr(int(c, 16)) for c in r.split("-")) for r in NEW_LETTERS]
RARE = re.compile("[" + "".join(RANGES) + "]")
#: What most texts have none of; cheaper to look for than RARE.
RARE_BASIC, BEYOND = re.compile("[" + "".join(r for r in RANGES if r[0] < "\U00010000") + "]"), re.compile("[\U00010000-\U0010ffff]")


def split(pattern: regex.Pattern, text: str) -> list[str]:
    """Matches of a split pattern, with letters and numbers as the library knows them."""
    if text.isascii() or not (RARE_BASIC.search(text) or BEYOND.search(text) and RARE.search(text)):
        return pattern.findall(text)
    plain = RARE.sub("\u203b", text)
    return [text[m.start() : m.end()] for m in pattern.finditer(plain)]


SPACE = regex.compile(r"\s+")
SEPARATORS = regex.compile("[\x1c-\x1f]")


def between(text: str, special: dict[str, int], splitter: regex.Pattern | None) -> Iterator[tuple[str, int | None]]:
    """The text cut at special strings: (piece, None) for text, ('', id) for a special token."""
    if splitter is None or not any(s in text for s in special):
        yield text, None
        return
    for piece in splitter.split(text):
        if piece in special:
            yield "", special[piece]
        elif piece:
            yield piece, None


class Encoder:
    """Whole texts to ids with the byte-level vocabulary."""

    def __init__(self, path: str):
        self.m = merges(path)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.m.special)) + ")") if self.m.special else None
        self.slot: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.slot.clear()
        self.held = 0
        self.ids, self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each text has."""
        if len(self.slot) > CACHE or self.held > CACHED:
            self.reset()
        slot, fresh, cells, per = self.slot, [], [], []
        special = {}
        for text in texts:
            n = len(cells)
            for piece, token in between(text, self.m.special, self.splitter):
                if token is not None:
                    special.setdefault(token, []).append(len(cells))
                    cells.append(-1)
                    continue
                found = split(BYTE_LEVEL, piece)
                try:
                    cells += [slot[w] for w in found]
                except KeyError:
                    for w in found:
                        k = slot.get(w)
                        if k is None:
                            k = slot[w] = len(slot)
                            fresh.append(w)
                        cells.append(k)
            per.append(len(cells) - n)
        if fresh:
            self.held += sum(map(len, fresh))
            ids, size = self.m.merge_rounds([w.encode() for w in fresh])
            self.at = np.concatenate([self.at, len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]])])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids])
        cell, at, size, ids = np.array(cells, np.int64), self.at, self.size, self.ids
        if special:
            at, size, ids = at.copy(), size.copy(), ids.copy()
            for token, places in special.items():
                cell[places] = len(at)
                at, size, ids = np.append(at, len(ids)), np.append(size, 1), np.append(ids, token)
        if not len(cell):
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        flat = gather(ids, at[cell], size[cell])
        ends = np.concatenate([[0], np.cumsum(size[cell])])
        stop = np.cumsum(per)
        return flat, ends[stop] - ends[stop - np.array(per, np.int64)]


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in groups of about CHUNK characters; null is empty."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text", carry: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Adds n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 and, with
    ``ids=True``, the token ids.  Null and empty texts have no tokens; special strings inside a text
    become their special token, as the library does by default.  ``carry`` columns pass through;
    rows repeat as they come; other columns are not read.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    src = docs.select(*carry, docs[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        m = enc.m
        word = np.array([b"%d," % i for i in range(len(m.token_len))], object)
        word_len = np.fromiter(map(len, word), np.int64, len(word))
        word_at = np.concatenate([[0], np.cumsum(word_len)])[:-1]
        word_flat = np.frombuffer(b"".join(word), np.uint8)
        for batch in batches:
            names = batch.schema.names[:-1]
            place = 0
            for part in chunks(batch.column(len(names)).to_pylist()):
                flat, per = enc.encode(part)
                stop = np.cumsum(per)
                listed = gather(word_flat, word_at[flat], word_len[flat]).tobytes()
                decoded = m.decode(flat)
                a = np.concatenate([[0], np.cumsum(word_len[flat])])
                b = np.concatenate([[0], np.cumsum(m.token_len[flat])])
                h1, h2 = [], []
                for s, e in zip((stop - per).tolist(), stop.tolist(), strict=True):
                    h1.append(hashlib.sha256(listed[a[s] : max(a[e] - 1, a[s])]).hexdigest())
                    body = decoded[b[s] : b[e]].decode("utf-8", "replace")
                    h2.append(hashlib.sha256(body.encode()).hexdigest())
                cols = [batch.column(i).slice(place, len(part)) for i in range(len(names))]
                cols += [pa.array(per), pa.array(h1, pa.string()), pa.array(h2, pa.string())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])
                place += len(part)

    small_batches(docs.sparkSession)
    return src.mapInArrow(tidied(run), schema)


#: Lower case of capitals that are newer than Python's character tables.
NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
def normalise(text: str) -> str:
    """NFC and lower case, letter by letter (a capital sigma never becomes a final one)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").translate(NEWER)
    return text.lower()


class Counter:
    """Token counts of whole texts with the word vocabulary; pre-tokens never cross white space."""

    def __init__(self, path: str):
        self.m = merges(path)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.m.special)) + ")") if self.m.special else None
        self.known: dict[str, int] = {}
        self.held = 0

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > CACHE or self.held > CACHED:
            self.known.clear()
            self.held = 0
        known, pieces, extra = self.known, [], []
        for text in texts:
            n, words = 0, []
            for piece, token in between(text, self.m.special, self.splitter):
                if token is None:
                    # str.split also cuts at the separators 1C-1F, which are ordinary characters here
                    words += SPACE.split(normalise(piece)) if SEPARATORS.search(piece) else normalise(piece).split()
                else:
                    n += 1
            pieces.append(words)
            extra.append(n)
        fresh = list({w for words in pieces for w in words if w not in known})
        if fresh:
            tokens = [split(WORD_LEVEL, w) for w in fresh]
            self.held += sum(map(len, fresh))
            size = self.m.survivors([t.encode() for ts in tokens for t in ts])
            per = np.fromiter(map(len, tokens), np.int64, len(tokens))
            ends = np.concatenate([[0], np.cumsum(size)])
            stop = np.cumsum(per)
            known.update(zip(fresh, (ends[stop] - ends[stop - per]).tolist(), strict=True))
        return [e + sum([known[w] for w in words]) for e, words in zip(extra, pieces, strict=True)]


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", carry: tuple[str, ...] = ("doc_id",), limit: int = 2048) -> DataFrame:
    """Tokens of every whole text with the word vocabulary, by ragged merge rounds that only count survivors.

    Adds n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``).  Null and empty texts count 0;
    special strings inside a text count as one special token each; rows repeat as they come.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    src = docs.select(*carry, docs[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) + ", n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            names = batch.schema.names[:-1]
            texts = batch.column(len(names))
            counts = np.array([n for part in chunks(texts.to_pylist()) for n in counter.count(part)], np.int64)
            size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            cols = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, size, pa.array(counts), pa.array(counts > limit)], names=[*names, "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return src.mapInArrow(tidied(run), schema)
