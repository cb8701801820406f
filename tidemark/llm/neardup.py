"""N-gram Jaccard join by parity sketches, exact at the stated similarity.

A document's set is its distinct word shingles.  Each shingle flips one bit of a long
parity sketch, so the Hamming distance of two sketches never exceeds the symmetric
difference of the sets.  At similarity s = 0.8 sets of sizes a and b link exactly when the
symmetric difference is at most (a + b) / 9, so within a size band it is at most some D.
Cut into more than D segments, the sketches of a linked pair agree on a whole segment
(pigeonhole): documents meet on (band, segment, segment fingerprint) and are verified on
their sets.  Segments without a bit tell nothing; they are left out, which stays exact
while a document has more than D segments with bits, and a document with fewer emits the
empty ones too.

Skew.  Equal sets collapse into one class before anything else.  A fingerprint held by
more than ``FEW`` classes is hot: only classes with at most D other segments need it (a
class with more is sure to meet each of its partners elsewhere).  Those classes are
compared with the most typical member only (a star); then, after components are known, pairs
of different components that still share a hot fingerprint are compared through a dense
parity sketch first and verified.  So no group is expanded into all its pairs, and no link
that could join two components is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ROW, discarded, input_bytes, numbered, recorded, released, small_batches, swept, tidied, tidy, written

SHINGLE = 5
#: Linked when HUNDREDTHS * union <= 100 * intersection.
HUNDREDTHS = 80
#: Size bands grow by this factor.
GROWTH = 1.6
#: A fingerprint in up to so many classes gives all their pairs; above, the star and the rest give the same links.
FEW = 8
#: Bytes of input (as stored) whose fingerprints one partition takes.
PART = 1 << 24
#: 64-bit words of the dense parity sketch that thins pairs before their texts are fetched.
DENSE = 16
SKETCH = [f"s{i}" for i in range(DENSE)]
WORDS = 200_000
P1, P2, P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * P1
    x = (x ^ (x >> np.uint64(29))) * P2
    return x ^ (x >> np.uint64(32))


class Hashes(dict):
    """Hash of each word seen; emptied when large (memory bound, no effect on results)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text: A-Z lower-cased, words between ASCII white space."""

    def __init__(self) -> None:
        self.known = Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        a = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(SHINGLE, len(a))
        out = a[: len(a) - n + 1].copy()
        for i in range(1, n):
            out *= P3
            out += a[i : len(a) - n + 1 + i]
            out ^= out >> np.uint64(29)
        out = mixed(out + np.uint64(n))
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def dense(shingles: np.ndarray) -> np.ndarray:
    """The parity sketch of 64 * DENSE bits: bit i is set if an odd number of shingles falls on it."""
    odd = np.bincount((shingles % np.uint64(64 * DENSE)).astype(np.int64), minlength=64 * DENSE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def class_id(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set: 10^10 different ones collide with a chance of about 10^-19."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def short(class_: bytes) -> int:
    """The half of a class by which fingerprints name it; classes that share it are told apart again before any text is compared."""
    return int.from_bytes(class_[:8], "little", signed=True)


def bands() -> list[int]:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * GROWTH))))
    return edges


EDGES = bands()


def most(k: int) -> int:
    """Largest symmetric difference of a linked pair whose larger set lies in band k."""
    return 2 * (EDGES[k + 1] - 1) * (100 - HUNDREDTHS) // (100 + HUNDREDTHS)


def segments(k: int) -> int:
    d = most(k)
    return d + 3 + d // 4


def band_of(n: int) -> list[int]:
    """Bands in which a set of n shingles takes part: its own, and those whose members it may link with from below."""
    k = int(np.searchsorted(EDGES, n, "right")) - 1
    out = [k]
    while 100 * n >= HUNDREDTHS * EDGES[out[-1] + 1]:
        out.append(out[-1] + 1)
    return [b for b in out if most(b) > 0]


def fingerprints(s: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Keys of the segments a set emits in band k, and how many of its segments have a bit.

    The sorted hashes lie in segments by range, so each segment is a slice of the set.
    """
    m = segments(k)
    seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    value = np.bitwise_xor.reduceat(mixed(s ^ P2), first)
    place = seg[first]
    full = len(first)
    if full <= most(k):
        empty = np.setdiff1d(np.arange(m, dtype=np.uint64), place)
        place, value = np.concatenate([place, empty]), np.concatenate([value, np.zeros(len(empty), np.uint64)])
    return mixed(value ^ (place * P3 + np.full(1, k, np.uint64) * P1)), full


def _emit(docs: DataFrame, text: str, ident: str, parts: int) -> DataFrame:
    """One pass over the texts: a row (id, n, class) for each document, and fingerprints packed by target
    partition (for each class and band its keys, 8 bytes each)."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(ident).alias("__id"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            ids, n_set, classes, seen = batch.column(0), [], [], set()
            sketches = []
            who, band, full, count, keys = [], [], [], [], []
            for t in batch.column(1):
                s = shingle(t.as_py())
                c = class_id(s)
                n_set.append(len(s))
                classes.append(c)
                sketches.append(dense(s))
                if not len(s) or c in seen:
                    continue
                seen.add(c)
                for k in band_of(len(s)):
                    f, n = fingerprints(s, k)
                    who.append(short(c))
                    band.append(k)
                    full.append(n)
                    count.append(len(f))
                    keys.append(f)
            ps, blobs = [], []
            if who:
                flat, entry = np.concatenate(keys), np.repeat(np.arange(len(who), dtype=np.int32), count)
                part = (flat % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                flat, entry, part = flat[order], entry[order], part[order]
                cuts = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
                head = np.array([who, band, full], np.int64)
                for k, p in enumerate(part[cuts[:-1]].tolist()):
                    own = entry[cuts[k] : cuts[k + 1]]
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    n = np.diff(np.append(first, len(own)))
                    ps.append(p)
                    blobs.append(np.int64(len(first)).tobytes() + head[:, own[first]].tobytes() + n.astype(np.int64).tobytes() + flat[cuts[k] : cuts[k + 1]].tobytes())
            m, k = len(classes), len(ps)
            cols = [pa.array([short(c) % parts for c in classes] + ps, pa.int32()), pa.array([None] * m + blobs, pa.binary()), pa.concat_arrays([ids, pa.nulls(k, ids.type)]), pa.array(n_set + [None] * k, pa.int64()), pa.array(classes + [None] * k, pa.binary())]
            bits = np.array(sketches, np.int64).reshape(m, DENSE)
            cols += [pa.concat_arrays([pa.array(np.ascontiguousarray(bits[:, i])), pa.nulls(k, pa.int64())]) for i in range(DENSE)]
            yield pa.RecordBatch.from_arrays(cols, names=["p", "blob", "id", "n", "class", *SKETCH])

    return src.mapInArrow(tidied(run), f"p int, blob binary, id {src.schema['__id'].dataType.simpleString()}, n long, class binary, " + ", ".join(f"{x} long" for x in SKETCH))


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[fresh], b[fresh]


#: A partition's fingerprints are sorted in so many slices, by their high bits.
SLICE_BITS = 3
SLICES = 1 << SLICE_BITS


def _meet(table: pa.Table) -> pa.Table:
    """One partition of fingerprints: pairs of small groups (kind 0) and members of hot ones (kind 1); documents pass (kind 2)."""
    blobs = table.column("blob")
    docs = table.filter(blobs.is_null())
    head, count, keys = [np.empty((3, 0), np.int64)], [], []
    for blob in blobs.drop_null():
        raw = blob.as_buffer()
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        x = np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n)
        head.append(x[:3])
        count.append(x[3])
        keys.append(np.frombuffer(raw, np.uint64, offset=8 + 32 * n))
    first = np.cumsum([0, *map(len, count)])
    head = np.concatenate(head, axis=1)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    hot_key, hot_entry = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    # equal keys share their high bits: a slice at a time bounds the sorted copies
    for high in range(SLICES):
        key, entry = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for k, own in enumerate(keys):
            pick = own >> np.uint64(64 - SLICE_BITS) == high
            key.append(own[pick])
            entry.append(np.repeat(np.arange(first[k], first[k + 1]), count[k])[pick])
        key, entry = np.concatenate(key).view(np.int64), np.concatenate(entry)
        order = np.argsort(key, kind="stable")
        key, entry = key[order], entry[order]
        same = key[1:] == key[:-1]
        multi = np.zeros(len(key), bool)
        multi[1:] |= same
        multi[:-1] |= same
        key, entry = key[multi], entry[multi]
        who = head[0][entry]
        order = np.lexsort((who, key))
        key, entry, who = key[order], entry[order], who[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])]) if len(key) else np.empty(0, bool)
        key, entry, who = key[fresh], entry[fresh], who[fresh]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        for n in range(2, FEW + 1):
            at = start[size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    u, v = distinct(who[at + i], who[at + j])
                    left.append(u)
                    right.append(v)
        hot = np.repeat(size > FEW, size)
        hot_key.append(key[hot])
        hot_entry.append(entry[hot])
    a, b = distinct(np.concatenate(left), np.concatenate(right))
    key, entry = np.concatenate(hot_key), np.concatenate(hot_entry)
    n, h = len(a), len(key)
    m = docs.num_rows
    kind = docs.schema.field("id").type

    members = pa.chunked_array(docs.column("class").chunks, pa.binary()).combine_chunks()
    halves = np.array([short(c) for c in members.to_pylist()], np.int64)
    cols = {
        "kind": np.concatenate([np.zeros(n, np.int32), np.ones(h, np.int32), np.full(m, 2, np.int32)]),
        "key": np.concatenate([np.zeros(n, np.int64), key, np.zeros(m, np.int64)]),
        "a": np.concatenate([a, head[0][entry], halves]),
        "b": np.concatenate([b, np.zeros(h + m, np.int64)]),
        "n": np.concatenate([np.zeros(n, np.int64), head[2][entry], docs.column("n").to_numpy()]),
        "band": np.concatenate([np.zeros(n, np.int32), head[1][entry].astype(np.int32), np.zeros(m, np.int32)]),
        "class": pa.concat_arrays([pa.nulls(n + h, pa.binary()), members]),
        "id": pa.concat_arrays([pa.nulls(n + h, kind), *docs.column("id").chunks]),
    }
    cols |= {x: pa.concat_arrays([pa.nulls(n + h, pa.int64()), *docs.column(x).chunks]) for x in SKETCH}
    tidy()
    return pa.table(cols)


#: Partners of one class that are verified by one task at most (about).
SPREAD = 256


def _texts(docs: DataFrame, text: str, ident: str, one: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class, text) of the classes in the pairs: texts travel, as they are smaller than sets."""
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    want = one.join(ends, "class", "left_semi")
    src = docs.select(F.col(ident).alias("__id"), F.col(text).alias("__text"))
    return src.join(want.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("__want"))).select("class", "__text")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.

    Every a meets its partners in tasks of about SPREAD of them: a's text is copied to each such task,
    partners go to one.
    """
    n = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.expr(f"CAST(1 + n div {SPREAD} AS int)"))
    dealt = pairs.join(n, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    heads = n.select("a", F.col("a").alias("b"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    rows = dealt.union(heads.select("a", "b", "salt")).withColumnRenamed("b", "class")
    rows = texts.join(rows.hint("shuffle_hash"), "class").select("a", "salt", "class", (F.col("class") != F.col("a")).alias("partner"), "__text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "partner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, at, own = Shingler(), None, np.empty(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for a, c, partner, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                s = shingle(t.as_py())
                if class_id(s) != c:
                    continue  # another row under the same identifier
                if not partner:
                    at, own = a, s
                elif at == a:
                    both = np.concatenate([own, s])
                    both.sort()
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * same >= HUNDREDTHS * (len(both) - same):
                        left.append(a)
                        right.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    return rows.mapInArrow(tidied(run), "a binary, b binary")


def _near(l: str, r: str) -> Column:
    """What holds for every linked pair: sizes in proportion, and a sketch distance within the bound on the difference."""
    apart = sum((F.bit_count(F.col(f"{l}.{x}").bitwiseXOR(F.col(f"{r}.{x}"))) for x in SKETCH), F.lit(0))
    n, m = F.col(f"{l}.n_shingles"), F.col(f"{r}.n_shingles")
    return (apart * (100 + HUNDREDTHS) <= (n + m) * (100 - HUNDREDTHS)) & (F.least(n, m) * 100 >= F.greatest(n, m) * HUNDREDTHS)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b): comp is the smallest node reachable.

    Labels shrink by the smallest label among neighbours and then by pointer jumping, until none changes.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("node"), "comp"))
    while True:
        before = label
        near = both.join(label.select(F.col("node").alias("b"), F.col("comp").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = label.join(near, F.col("node") == F.col("a")).select("node", F.least("comp", "near").alias("low"), F.col("comp").alias("old"))
        jump = step.join(label.select(F.col("node").alias("low"), F.col("comp").alias("far")), "low").select("node", F.least("low", "far").alias("comp"), (F.least("low", "far") < F.col("old")).alias("moved"))
        label = written(jump)
        discarded(before)
        if label.where("moved").isEmpty():
            discarded(both)
            return label.select("node", "comp")


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: ident, n_shingles, component_id (smallest identifier reachable by links).

    Null and empty texts have no shingles and link with nothing.  Rows with equal texts link, equal
    identifiers included; a null identifier never becomes a component's, unless no member has one.
    Other columns are not read.
    """
    spark = docs.sparkSession
    src = docs.select(ident, text)
    # from the input alone: each further partition repeats the heads of the sets that it takes fingerprints of
    size = input_bytes(src)
    parts = max(24, size // PART if size else int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = _emit(src, text, ident, parts)
    shape = f"kind int, key long, a long, b long, n long, band int, class binary, id {met.schema['id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in SKETCH)
    met = written(met.groupBy("p").applyInArrow(_meet, shape))
    released(spark)
    rows = met.where("kind = 2").select(F.col("id").alias("__id"), F.col("n").alias("n_shingles"), "class")
    sketch = written(met.where("kind = 2 AND n > 0").select("class", F.col("a").alias("short"), F.col("n").alias("n_shingles"), *SKETCH).dropDuplicates(["class"]))
    hot = met.where("kind = 1").select("band", "key", F.col("a").alias("short"), F.col("n").alias("full"))
    limit = F.element_at(F.array(*[F.lit(most(k)) for k in range(len(EDGES) - 1)]), F.col("band") + 1)
    need = hot.groupBy("band", "short").agg(F.count(F.lit(1)).alias("n"), F.min("full").alias("full")).where(F.col("full") - F.col("n") <= limit).select("band", "short", "n")
    hot = written(hot.join(need, ["band", "short"]).select("band", "key", "short", "n"))
    # the centre of a star is the member with most hot fingerprints: the text that most others are copies of
    centre = hot.groupBy("band", "key").agg(F.max_by("short", F.struct("n", "short")).alias("a"))
    star = hot.join(centre, ["band", "key"]).where("a != short").groupBy("a", F.col("short").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    met_pairs = met.where("kind = 0").select("a", "b", F.lit(0).cast("long").alias("w")).union(star).groupBy("a", "b").agg(F.max("w").alias("w"))
    l, r = sketch.alias("l"), sketch.alias("r")  # noqa: E741
    named = met_pairs.join(l, F.col("a") == F.col("l.short")).join(r, F.col("b") == F.col("r.short")).where(_near("l", "r")).select(F.col("l.class").alias("a"), F.col("r.class").alias("b"), "w")
    # different classes under one half
    twins = sketch.groupBy("short").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a != b").select("a", "b", F.lit(0).cast("long").alias("w"))
    pairs = named.union(twins)
    pairs = written(pairs)
    one = rows.where("n_shingles > 0").groupBy("class").agg(F.min("__id").alias("__want"))
    texts = written(_texts(docs, text, ident, one, pairs))
    released(spark)
    # each class meets its likeliest partner first; later only pairs that could still join two components
    edges = written(_verified(pairs.groupBy("b").agg(F.max_by("a", F.struct("w", "a")).alias("a")).select("a", "b"), texts))
    label = components(edges)
    named_pairs = pairs.join(label.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    later = written(named_pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    if not later.isEmpty():
        found = written(_verified(later, texts))
        if not found.isEmpty():
            edges = edges.union(found)
            label = components(edges)
    released(spark)
    # pairs of different components that share a hot fingerprint: the dense sketches thin them first
    tagged = hot.join(sketch.select("short", "class"), "short").select("band", "key", "class").join(label.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    split = tagged.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", "key")
    rest = written(tagged.join(split, ["band", "key"], "left_semi").distinct())
    if not rest.isEmpty():
        meets = (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") != F.col("r.comp")) & _near("l", "r")
        # merge joins: a small file may hold many rows, too many to broadcast
        rest = rest.withColumn("prior", F.lag("key").over(Window.partitionBy("band", "class").orderBy("key")))
        # not again where the fingerprints before this one are shared too
        meets = meets & (F.col("l.class") < F.col("r.class")) & F.coalesce(F.col("l.prior") != F.col("r.prior"), F.lit(True))
        big = written(rest.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPREAD))
        full = rest.join(big.select("band", "key"), ["band", "key"], "left_anti").join(sketch.hint("merge"), "class")
        more = full.alias("l").join(full.alias("r").hint("merge"), meets).select(F.col("l.class").alias("a"), F.col("r.class").alias("b"))
        if not big.isEmpty():
            # members of a larger fingerprint are dealt to tasks of about SPREAD on the one side; the other side meets each of them
            full = rest.join(big, ["band", "key"]).join(sketch.hint("merge"), "class").withColumn("salts", F.expr(f"CAST(1 + n div {SPREAD} AS int)"))
            l = full.withColumn("salt", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int")).alias("l")  # noqa: E741
            r = full.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).alias("r").hint("merge")
            more = more.union(l.join(r, meets & (F.col("l.salt") == F.col("r.salt"))).select(F.col("l.class").alias("a"), F.col("r.class").alias("b")))
        more = written(more.distinct())
        texts = _texts(docs, text, ident, one, more) if not more.isEmpty() else texts
        found = written(_verified(more, texts))
        if not found.isEmpty():
            label = components(edges.union(found))
    named = rows.join(label.select(F.col("node").alias("class"), "comp"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    low = named.where("n_shingles > 0").groupBy("comp").agg(F.min("__id").alias("low"))
    out = named.join(low, "comp", "left")
    return out.select(F.col("__id").alias(ident), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("__id")).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows without near duplicates: of each component exactly one row stays, one with the smallest identifier.

    A null identifier comes after all others; among rows that share the smallest one the first by row
    number stays.  Texts without words are left alone.  Rows that repeat an identifier are told apart.
    """
    rows = numbered(docs)
    steps: list[str] = []
    with recorded(steps):
        found = written(near_duplicates(rows, text, ROW).where("n_shingles > 0").select(ROW, F.col("component_id").alias("__comp")))
    swept(found, steps)
    # a component of one row needs no look at its identifier
    many = found.where(F.col(ROW) != F.col("__comp")).select("__comp").distinct()
    met = written(found.join(many, "__comp").join(rows.select(ROW, F.col(ident).alias("__ident")), ROW))
    best = met.groupBy("__comp").agg(F.min(F.struct(F.col("__ident").isNull().alias("lost"), F.col("__ident"), F.col(ROW))).alias("best")).select(F.col(f"best.{ROW}").alias(ROW))
    gone = written(met.select(ROW).join(best, ROW, "left_anti"))
    return rows.join(gone, ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same result by plain joins on shingles.
ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, y FROM reach JOIN links ON reach.r = x)
SELECT words.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.low, words.doc_id) AS component_id FROM words LEFT JOIN n ON n.doc_id = words.doc_id LEFT JOIN (SELECT doc_id, min(r) AS low FROM reach GROUP BY 1) c ON c.doc_id = words.doc_id
"""
