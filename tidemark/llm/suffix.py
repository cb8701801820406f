"""Suffix-array dedup: remove every byte of a 200-byte string that starts anywhere else in the corpus.

A sparse suffix array.  Every window of ``SPAN`` bytes has an anchor, the place of its smallest
hashed 8-byte gram among those that leave ``CORE`` bytes of the window, so equal windows have
their anchor at the same place.  Only suffixes at anchors are sorted:

1. Anchors are found in numpy; only the hash of the ``CORE`` bytes at each travels, and anchors
   whose core is unique are dropped.
2. For the rest, the bytes around the anchor that its windows cover travel.  Each batch sorts its
   suffixes and sends them as front-coded runs: the length of the prefix shared with the suffix
   before, then the rest.
3. A loser tree merges the runs of a partition.  It keeps for every run the prefix length its head
   shares with the last winner, so no comparison looks at bytes that are known to be equal, and the
   merge yields the suffix array with its array of longest common prefixes.
4. Left contexts, reversed, are sorted the same way: every batch sends them as a second front-coded run
   with their places in the first, and a second loser tree merges those.  A window at distance p after its start from
   the anchor repeats iff another anchor is in the same class of right contexts at depth SPAN - p
   and of left contexts at depth p; classes follow from the prefix arrays by running counts.

Segments that are equal byte for byte travel once from each batch with a list of owners, so a
passage in a third of all documents does not multiply in the merge.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, released, written

SPAN = 200
CORE = 32
#: Offsets inside a window at which its anchor may lie: 0 to ROOM.
ROOM = SPAN - CORE
M1, M2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xD6E8FEB86659FD93)
POWER = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * M1
    x ^= x >> np.uint64(32)
    x *= M2
    x ^= x >> np.uint64(29)
    return x


def grams(data: np.ndarray) -> np.ndarray:
    """The hashed 8-byte string at every place that has one."""
    n = len(data) - 7
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(8):
        out |= data[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    return mix(out)


def window_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest value, the first of equals, in each run of w values: running minima from both block ends.

    The low byte of each value is replaced by its place in its block, which decides ties.
    """
    n = len(h) - w + 1
    v = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    v[: len(h)] = h & ~np.uint64(255)
    v.reshape(-1, w)[:] |= np.arange(w, dtype=np.uint64)
    block = v.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()[w - 1 : w - 1 + n]
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    start = np.arange(n)
    left = behind >> np.uint64(8) <= ahead >> np.uint64(8)
    return np.where(left, start // w * w + (behind & np.uint64(255)).astype(np.int64), (start + w - 1) // w * w + (ahead & np.uint64(255)).astype(np.int64))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, least p, greatest p) in texts laid end to end: each anchor, and how far before it the windows start whose anchor it is."""
    if len(data) < SPAN:
        return (np.empty(0, np.int64),) * 3
    at = window_minimum(grams(data)[: len(data) - CORE + 1], ROOM + 1)
    start = np.arange(len(at))
    doc = np.searchsorted(ends, start, "right")
    whole = start + SPAN <= ends[np.minimum(doc, len(ends) - 1)]
    start, at, doc = start[whole], at[whole], doc[whole]
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    return place, place - start[last], place - start[first]


def core_hash(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the CORE bytes at each place."""
    out = np.zeros(len(place), np.uint64)
    for j in range(0, CORE, 8):
        word = np.zeros(len(place), np.uint64)
        for i in range(8):
            word |= data[place + j + i].astype(np.uint64) << np.uint64(8 * i)
        out = mix(out ^ word) + np.uint64(j)
    return out.view(np.int64)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that ``known`` bytes agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 16
    while a[known : known + step] == b[known : known + step]:
        known += step
    x = int.from_bytes(a[known : known + step].ljust(step, b"\0"), "big") ^ int.from_bytes(b[known : known + step].ljust(step, b"\0"), "big")
    return min(n, known + (step * 8 - x.bit_length()) // 8)


def front_code(sorted_suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared prefix lengths, lengths of the rest, the rests) of a sorted run."""
    shared, size, rest, before = [], [], [], b""
    for s in sorted_suffixes:
        k = common(before, s, 0)
        shared.append(k)
        size.append(len(s) - k)
        rest.append(s[k:])
        before = s
    return np.array(shared, np.int16), np.array(size, np.int16), b"".join(rest)


def front_decode(shared: np.ndarray, size: np.ndarray, rest: bytes) -> Iterator[tuple[bytes, int]]:
    at, before = 0, b""
    for k, n in zip(shared.tolist(), size.tolist(), strict=True):
        before = before[:k] + rest[at : at + n]
        at += n
        yield before, k


class LoserTree:
    """Merge of sorted runs that never compares known prefixes.

    Every run's head carries the length of the prefix it shares with the last winner.  Of two heads
    the one that shares more is the smaller; only if both share the same length are bytes after it
    compared, and then the loser learns how much it shares with the new winner.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int]]]):
        self.runs, self.k = runs, len(runs)
        self.head: list[bytes | None] = [None] * self.k
        self.lcp = [0] * self.k
        for i in range(self.k):
            self._pull(i)
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._enter(i)

    def _pull(self, i: int) -> None:
        nxt = next(self.runs[i], None)
        # the next head of the winner's own run: its shared length is the run's front code
        self.head[i], self.lcp[i] = nxt if nxt else (None, -1)

    def _less(self, i: int, j: int) -> bool:
        """Whether head i goes before head j; updates the loser's shared length."""
        a, b = self.head[i], self.head[j]
        if a is None or b is None:
            return a is not None or (b is None and i < j)
        x, y = self.lcp[i], self.lcp[j]
        if x != y:
            return x > y
        k = common(a, b, x)
        less = (k == len(a) and (k < len(b) or i < j)) or (k < len(a) and k < len(b) and a[k] < b[k])
        self.lcp[j if less else i] = k
        return less

    def _enter(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.loser[node]
            if other < 0:
                self.loser[node] = i
                return
            if self._less(other, i):
                self.loser[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        """(run, suffix, prefix shared with the suffix before)."""
        if not self.k:
            return
        while (s := self.head[self.winner]) is not None:
            i = self.winner
            yield i, s, self.lcp[i]
            self._pull(i)
            node = (i + self.k) // 2
            while node > 0:
                other = self.loser[node]
                if self._less(other, i):
                    self.loser[node], i = i, other
                node //= 2
            self.winner = i


def classes(lcp: np.ndarray, depth: int) -> np.ndarray:
    """Class of each place of a sorted array at a depth: neighbours that share depth bytes are together."""
    return np.cumsum(lcp < depth)


def repeated(right_lcp: np.ndarray, left_rank: np.ndarray, left_lcp: np.ndarray, least: np.ndarray, most: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each suffix (in right order) a row of bits: whether its window at distance p repeats, p in 0..ROOM.

    ``left_rank`` is the place of each suffix in the order of left contexts, ``weight`` how many
    owners its segment has (two owners repeat each other).
    """
    n = len(right_lcp)
    out = np.zeros((n, ROOM + 1), bool)
    for p in range(ROOM + 1):
        own = np.flatnonzero((least <= p) & (p <= most))
        if not len(own):
            continue
        key = classes(right_lcp, SPAN - p)[own].astype(np.int64) * (n + 1) + classes(left_lcp, p)[left_rank[own]]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
        total = np.add.reduceat(weight[own][order], first)
        many = np.repeat(total > 1, np.diff(np.append(first, len(own))))
        out[own[order[many]], p] = True
    return out


#: A core with more anchors than this is dealt by longer strings; windows start at most HALF before their
#: anchor in the one kind of share, and more in the other.
HOT, HALF = 2000, ROOM // 2
#: Bytes of text handled together, and bytes of suffixes that one partition takes, at about SUFFIX bytes each.
CHUNK, PART, SUFFIX = 1 << 20, 1 << 26, 400
#: At most so many cores are looked up by broadcast; the threshold rises with the anchors, so there cannot be more.
HEAVY = 1 << 16


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, text) -> (core, uid, spot): spot packs the anchor's place, a bit for hot cores, and its least and greatest p."""
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1)
        at = 0
        while at < len(ids):
            part, size, first = [], 0, at
            while at < len(ids) and (size < CHUNK or not part):
                part.append((texts[at].as_py() or "").encode())
                size += len(part[-1])
                at += 1
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            data = np.frombuffer(b"".join(part), np.uint8)
            place, least, most = anchors(data, ends)
            doc = np.searchsorted(ends, place, "right")
            own = place - np.concatenate([[0], ends])[doc]
            yield pa.RecordBatch.from_arrays([pa.array(core_hash(data, place)), pa.array(ids[first:at][doc]), pa.array(own << 17 | least << 8 | most)], names=["core", "uid", "spot"])


def put(into: dict, uid: int, raw: bytes, a: int, lo: int, hi: int) -> None:
    """Note the owner of the suffix at ``a``, under its right part, reversed left part and bounds."""
    into.setdefault((raw[a : a - lo + SPAN], raw[a - hi : a][::-1], lo, hi), []).append((uid, a))


def _runs(parts: int):
    """(uid, text, spots) -> (p, run): sorted front-coded runs of the suffixes at the spots, by target partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, dict] = defaultdict(dict)
            for uid, text, spots in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                spot = spots.values.to_numpy()
                place, hot, least, most = spot >> 17, spot >> 16 & 1, spot >> 8 & 255, spot & 255
                core = core_hash(np.frombuffer(raw, np.uint8), place)
                where = (core.view(np.uint64) % np.uint64(parts)).tolist()
                for p, a, h, lo, hi in zip(where, place.tolist(), hot.tolist(), least.tolist(), most.tolist(), strict=True):
                    if not h:
                        put(found[p], uid, raw, a, lo, hi)
                        continue
                    # a hot core is dealt by more of what its windows share: the bytes after it, or those before it
                    if lo <= HALF:
                        put(found[xxhash.xxh3_64_intdigest(raw[a : a + SPAN - HALF]) % parts], uid, raw, a, lo, min(hi, HALF))
                    if hi > HALF:
                        put(found[xxhash.xxh3_64_intdigest(raw[a - HALF - 1 : a + CORE]) % parts], uid, raw, a, max(lo, HALF + 1), hi)
            ps, blobs = [], []
            for p, own in found.items():
                keys = sorted(own)
                lefts = [k[1] for k in keys]
                turn = sorted(range(len(keys)), key=lefts.__getitem__)
                owners = np.array([o for k in keys for o in own[k]], np.int64)
                bounds = np.array([[k[2], k[3]] for k in keys], np.uint8)
                count = np.array([len(own[k]) for k in keys], np.int32)
                parts_of = [owners, count, *front_code([k[0] for k in keys]), bounds, np.array(turn, np.int32), *front_code([lefts[i] for i in turn])]
                raw = [x if isinstance(x, bytes) else x.tobytes() for x in parts_of]
                ps.append(p)
                blobs.append(np.array([len(keys), *map(len, raw)], np.int64).tobytes() + b"".join(raw))
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), pa.array(blobs, pa.binary())], names=["p", "run"])

    return run


#: The pieces of a run: owners, owners of each entry, right contexts, bounds, order of the left contexts, left contexts.
KINDS = (np.int64, np.int32, np.int16, np.int16, None, np.uint8, np.int32, np.int16, np.int16, None)


def _pieces(raw: bytes) -> list:
    size = np.frombuffer(raw, np.int64, 1 + len(KINDS))[1:].tolist()
    at, out = 8 * (1 + len(KINDS)), []
    for n, kind in zip(size, KINDS, strict=True):
        out.append(raw[at : at + n] if kind is None else np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _merged(runs: list[Iterator[tuple[bytes, int]]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(places of each run's entries in the merged order, run of each place, prefix shared with the place before)."""
    run, lcp = [], []
    for i, _, k in LoserTree(runs):
        run.append(i)
        lcp.append(k)
    run_of = np.array(run, np.int64)
    # the merge takes each run in order, so its places in order are those of its entries
    by_run = np.argsort(run_of, kind="stable")
    return np.split(by_run, np.searchsorted(run_of[by_run], np.arange(1, max(len(runs), 1)))), run_of, np.array(lcp, np.int64)


def _merge(table: pa.Table) -> pa.Table:
    """One partition's runs -> (uid, start, stop): the bytes that repeated windows cover."""
    meta = [_pieces(blob.as_py()) for blob in table.column("run")]
    places, run_of, lcp = _merged([front_decode(*x[2:5]) for x in meta])
    left_places, _, left_lcp = _merged([front_decode(*x[7:10]) for x in meta])
    n = len(run_of)
    inside, rank = np.empty(n, np.int64), np.empty(n, np.int64)
    bounds, weight = np.empty((n, 2), np.int64), np.empty(n, np.int64)
    for (_, count, _, _, _, bound, turn, _, _, _), own, left in zip(meta, places, left_places, strict=False):
        inside[own] = np.arange(len(own))
        bounds[own], weight[own] = bound.reshape(-1, 2), count
        rank[own[turn]] = left
    uid, start, stop = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if n:
        bits = np.zeros((n, ROOM + 3), np.int8)
        bits[:, 1:-1] = repeated(lcp, rank, left_lcp, bounds[:, 0], bounds[:, 1], weight)
        edge = np.diff(bits, axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        order = np.argsort(run_of[row], kind="stable")
        cuts = np.searchsorted(run_of[row][order], np.arange(len(meta) + 1))
        for i, (owners, count, *_) in enumerate(meta):
            own = order[cuts[i] : cuts[i + 1]]
            owners = owners.reshape(-1, 2)
            entry = inside[row[own]]
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            times = count[entry].astype(np.int64)
            each = np.repeat(first[entry] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
            uid.append(owners[each, 0])
            start.append(owners[each, 1] - np.repeat(high[own] - 1, times))
            stop.append(owners[each, 1] - np.repeat(low[own], times) + SPAN)
    return pa.table({"uid": np.concatenate(uid), "start": np.concatenate(start), "stop": np.concatenate(stop)})


def union(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the intervals; intervals that touch are one run."""
    out: list[list[int]] = []
    for i in np.argsort(start, kind="stable").tolist():
        a, b = int(start[i]), int(stop[i])
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), kept: bool = False) -> DataFrame:
    """One row per document: carry columns, n_bytes, n_removed, n_spans, kept_sha256 and, with ``kept``, the remaining bytes.

    Removes every byte covered by a 200-byte string (UTF-8) that also starts elsewhere in any row, the same
    row and rows that repeat an identifier included; strings are judged on the input.  Null texts are empty.
    Texts under 200 bytes stay whole.  The documents must come from a source that yields the same rows in
    the same partitions each time it is read, as a Parquet table does.
    """
    spark = docs.sparkSession
    named = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(carry)], F.col(text).alias("text")).withColumn("uid", F.monotonically_increasing_id())
    plain = named.select("uid", "text")
    found = written(plain.mapInArrow(_find, "core long, uid long, spot long"))
    # cores of very many anchors meet them by broadcast, so they are not gathered in one task; n anchors have fewer than n / (n / HEAVY) of them
    many = max(HOT, found.count() // HEAVY)
    twice = written(found.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    heavy = F.broadcast(twice.where(F.col("n") > many))
    met = found.join(heavy.select("core"), "core", "left_anti").join(twice.where(F.col("n") <= many), "core").unionByName(found.join(heavy, "core"))
    hot = F.when(F.col("n") > HOT, F.col("spot").bitwiseOR(1 << 16)).otherwise(F.col("spot"))
    spots = written(met.groupBy("uid").agg(F.sort_array(F.collect_list(hot)).alias("spots")))
    discarded(found, twice)
    released(spark)
    # partitions grow with what there is to sort
    anchors = spots.agg(F.sum(F.size("spots")).alias("n")).first().n or 0
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")), anchors * SUFFIX // PART)
    runs = plain.join(spots.hint("shuffle_hash"), "uid").select("uid", "text", "spots").mapInArrow(_runs(parts), "p int, run binary")
    covered = written(runs.groupBy("p").applyInArrow(_merge, "uid long, start long, stop long"))
    released(spark)
    spans = covered.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = named.join(spans.hint("shuffle_hash"), "uid", "left").select(*[f"__k{i}" for i in range(len(carry))], "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, n_runs, digest, left = [], [], [], [], []
            for t, spans in zip(batch.column(len(carry)), batch.column(len(carry) + 1), strict=True):
                raw = (t.as_py() or "").encode()
                found = []
                if spans.is_valid:
                    start, stop = spans.values.flatten()
                    found = union(start.to_numpy(), stop.to_numpy())
                pieces, at = [], 0
                for a, b in found:
                    pieces.append(raw[at:a])
                    at = b
                rest = b"".join([*pieces, raw[at:]])
                total.append(len(raw))
                removed.append(len(raw) - len(rest))
                n_runs.append(len(found))
                digest.append(hashlib.sha256(rest).hexdigest())
                left.append(rest)
            cols = [batch.column(i) for i in range(len(carry))] + [pa.array(x, pa.int64()) for x in (total, removed, n_runs)] + [pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(left, pa.binary())] * kept, names=[*carry, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * kept])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return rows.mapInArrow(cut, kinds + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept)
