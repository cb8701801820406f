"""FLAC in numpy: whole streams of fixed-size frames are coded and decoded many frames at a time.

Coding: 8-bit mono blocks of 576 samples; each frame takes the fixed linear predictor
(order 0 to 2) and Rice parameter with the fewest bits, or is stored verbatim.  Decoding:
Rice residuals of all frames advance together, one sample a step; predictors are undone by
cumulative sums; header CRC-8 and frame CRC-16 are verified over all frames at once, and
the stream's MD5 at the end.  A general scalar decoder handles streams of other coders:
constant, verbatim, fixed and LPC subframes, wasted bits, escaped partitions, any block
size, 4 to 32 bits a sample, up to 8 channels with or without stereo decorrelation.

``pcm_blocks`` writes what is decoded as PCM blocks, each with its first sample and its
offset in bytes, so that a reader goes to a sample without what is before it.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 576
RATE = 16000
#: Frames coded or decoded together (bounds memory).
BATCH = 4096
MAGIC = b"fLaC"


@functools.cache
def crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16 if bits == 16 else np.uint8)


@functools.cache
def crc16_pair_table() -> np.ndarray:
    """CRC-16 of a state advanced by two zero bytes, for every state: two bytes a step."""
    t = crc_table(16, 0x8005)
    s = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        s = ((s << 8) & 0xFFFF) ^ t[s >> 8]
    return s.astype(np.uint16)


def crc8(data: bytes) -> int:
    t, c = crc_table(8, 0x07), 0
    for b in data:
        c = int(t[c ^ b])
    return c


def crc16_rows(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of ``flat[start:start+length]`` for every row, all rows advancing together.

    Rows are right-aligned: leading zero bytes do not change a CRC that starts at zero.
    """
    pair = crc16_pair_table()
    n = int(length.max(initial=0))
    n += n & 1
    c = np.zeros(len(start), np.uint16)
    at = start + length - n
    padded = np.concatenate([np.zeros(n + 2, np.uint8), flat])
    at = at + n + 2
    skip = n - length
    for i in range(0, n, 2):
        hi = np.where(skip <= i, padded[at + i], 0).astype(np.uint16)
        lo = np.where(skip <= i + 1, padded[at + i + 1], 0).astype(np.uint16)
        c = pair[c ^ (hi << np.uint16(8) | lo)]
    return c


def utf8_number(n: int) -> bytes:
    """The frame number in the format's extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    first = 0x3F
    while n > first:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        first >>= 1
    lead = (~first << 1) & 0xFF | n
    return bytes([lead, *reversed(tail)])


@functools.lru_cache(maxsize=1 << 16)
def frame_header(number: int) -> bytes:
    """Fixed block size 576 (code 2), 16 kHz (code 5), one channel, 8 bits a sample."""
    head = bytes([0xFF, 0xF8, 0x2 << 4 | 0x5, 0x0 << 4 | 0x1 << 1]) + utf8_number(number)
    return head + bytes([crc8(head)])


def streaminfo(samples: int, md5: bytes, smallest: int, largest: int) -> bytes:
    packed = RATE << 44 | 0 << 41 | 7 << 36 | samples
    return struct.pack(">HH", BLOCK, BLOCK) + smallest.to_bytes(3, "big") + largest.to_bytes(3, "big") + packed.to_bytes(8, "big") + md5


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of an (n, BLOCK) int array."""
    n = len(samples)
    x = samples.astype(np.int32)
    d1 = np.diff(x, axis=1)
    d2 = np.diff(d1, axis=1)
    coded = []
    for order, d in ((0, x), (1, d1), (2, d2)):
        z = (d << 1) ^ (d >> 31)
        coded.append((order, z))
    best = np.full(n, BLOCK * 8, np.int64)  # verbatim
    pick, rice = np.full(n, -1), np.zeros(n, np.int64)
    for order, z in coded:
        total = z.sum(axis=1)
        guess = np.maximum(np.log2(np.maximum(total / z.shape[1], 1)).astype(np.int64) - 1, 0)
        for step in (0, 1):
            k = np.minimum(guess + step, 14)
            bits = 8 * order + 6 + 4 + (z >> k[:, None]).sum(axis=1) + (k + 1) * z.shape[1]
            better = bits < best
            best[better], pick[better], rice[better] = bits[better], order, k[better]
    out: list[bytes] = [b""] * n
    for order in (-1, 0, 1, 2):
        rows = np.flatnonzero(pick == order)
        if not len(rows):
            continue
        heads = [frame_header(i) for i in numbers[rows].tolist()]
        if order < 0:
            bodies = [b"\x02" + r.astype(np.int8).tobytes() for r in samples[rows]]
        else:
            z, k = coded[order][1][rows], rice[rows]
            q = z >> k[:, None]
            width = q + 1 + k[:, None]
            lead = 8 + 8 * order + 10
            ends = lead + np.cumsum(width, axis=1)
            size = (ends[:, -1] + 7) // 8
            base = np.concatenate([[0], np.cumsum(size)[:-1]]) * 8
            total = int(size.sum())
            bit = np.zeros(total * 8, np.uint8)
            stop = base[:, None] + ends - width + q  # the one that ends each unary part
            bit[stop.ravel()] = 1
            for b in range(int(k.max(initial=0))):  # low bits, from the least
                has = k > b
                bit[(base[has][:, None] + ends[has] - 1 - b).ravel()] = ((z[has] >> b) & 1).ravel()
            for b in range(4):  # Rice parameter; partition order and coding method are zero
                bit[base + lead - 4 + b] = (k >> (3 - b)) & 1
            flat = np.packbits(bit)
            byte = base // 8
            flat[byte] = (8 + order) << 1
            for i in range(order):
                flat[byte + 1 + i] = x[rows, i].astype(np.uint8)
            raw = flat.tobytes()
            bodies = [raw[s : s + e] for s, e in zip(byte.tolist(), size.tolist(), strict=True)]
        frames = [h + b for h, b in zip(heads, bodies, strict=True)]
        length = np.fromiter(map(len, frames), np.int64, len(frames))
        crc = crc16_rows(np.frombuffer(b"".join(frames), np.uint8), np.cumsum(length) - length, length)
        for i, f, c in zip(rows.tolist(), frames, crc.tolist(), strict=True):
            out[i] = f + struct.pack(">H", c)
    return out


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of BLOCK; bytes are samples minus 128.

    A seek table gives the sample number and byte offset of every 64th frame.
    """
    count = [len(p) // BLOCK for p in payloads]
    numbers = np.concatenate([np.arange(c) for c in count]) if count else np.empty(0, np.int64)
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    frames: list[bytes] = []
    for s in range(0, len(flat), BATCH):
        frames += encode_frames(flat[s : s + BATCH].astype(np.int16) - 128, numbers[s : s + BATCH])
    out, at = [], 0
    for p, c in zip(payloads, count, strict=True):
        own = frames[at : at + c]
        at += c
        size = [len(f) for f in own]
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ np.uint8(128)).tobytes()).digest()  # samples as signed bytes
        points, offset = [], 0
        for i, f in enumerate(size):
            if i % 64 == 0:
                points.append(struct.pack(">QQH", i * BLOCK, offset, BLOCK))
            offset += f
        info, table = streaminfo(len(p), md5, min(size), max(size)), b"".join(points)
        out.append(MAGIC + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


class Corrupt(ValueError):
    """The stream does not hold what its checksums state."""


def metadata(stream: bytes) -> tuple[dict, list[tuple[int, int, int]], int]:
    """Stream information, seek points and the offset of the first frame."""
    if stream[:4] != MAGIC:
        raise Corrupt("no FLAC stream")
    at, info, seek, last = 4, {}, [], False
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"block": struct.unpack(">HH", body[:4]), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            seek = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, len(body), 18)]
    return info, seek, at


def _frame_starts(flat: np.ndarray, first: int, count: int) -> np.ndarray | None:
    """Offsets of frames of the layout that encode_streams writes, found by their whole headers; None if another layout."""
    sync = np.flatnonzero((flat[first:-4] == 0xFF) & (flat[first + 1 : -3] == 0xF8) & (flat[first + 2 : -2] == 0x25) & (flat[first + 3 : -1] == 0x02)) + first
    raw = flat.tobytes()
    starts, want = [], 0
    for s in sync.tolist():
        if want < count:
            head = frame_header(want)
            if raw[s : s + len(head)] == head:
                starts.append(s)
                want += 1
    return np.array(starts, np.int64) if want == count else None


def _decode_batch(flat: np.ndarray, start: np.ndarray, end: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Samples (n, BLOCK) of frames with fixed predictors or verbatim data; raises Corrupt on a bad checksum."""
    crc = crc16_rows(flat, start, end - start - 2)
    stored = flat[end - 2].astype(np.uint16) << np.uint16(8) | flat[end - 1]
    if (crc != stored).any():
        raise Corrupt("frame checksum")
    kind = flat[start + head]
    out = np.empty((len(start), BLOCK), np.int32)
    body = start + head + 1
    for row in np.flatnonzero(kind == 2).tolist():
        out[row] = flat[body[row] : body[row] + BLOCK].view(np.int8)
    for order in (0, 1, 2):
        rows = np.flatnonzero(kind == (8 + order) << 1)
        if not len(rows):
            continue
        at = body[rows]
        warm = [flat[at + i].view(np.int8).astype(np.int32) for i in range(order)]
        size = end[rows] - 2 - at
        width = int(size.max())
        take = np.minimum(at[:, None] + np.arange(width + 8), len(flat) - 1)
        bits = np.unpackbits(flat[take], axis=1)
        rowlen = bits.shape[1]
        lin = bits.ravel()
        # for every bit the place of the next one: a reversed running minimum over the places of ones
        place = np.where(lin == 1, np.arange(len(lin), dtype=np.int32), np.int32(len(lin)))
        after = np.minimum.accumulate(place[::-1])[::-1]
        packed = np.packbits(lin)
        window = (packed[:-3].astype(np.uint32) << 24) | (packed[1:-2].astype(np.uint32) << 16) | (packed[2:-1].astype(np.uint32) << 8) | packed[3:]
        pos = (np.arange(len(rows)) * rowlen + 8 * order + 6).astype(np.int64)
        k = ((window[pos >> 3] >> (28 - (pos & 7)).astype(np.uint32)) & 15).astype(np.int64)
        if (lin[pos - 6] | lin[pos - 5] | lin[pos - 4] | lin[pos - 3] | lin[pos - 2] | lin[pos - 1]).any() or (k == 15).any():
            raise NotImplementedError
        pos += 4
        n = BLOCK - order
        z = np.empty((n, len(rows)), np.int32)
        mask, down = (1 << k) - 1, 32 - k
        for i in range(n):
            one = after[pos].astype(np.int64)
            low_at = one + 1
            low = (window[low_at >> 3].astype(np.int64) >> (down - (low_at & 7))) & mask
            z[i] = (one - pos) << k | low
            pos = low_at + k
        d = ((z >> 1) ^ -(z & 1)).T
        if order == 2:
            d1 = np.concatenate([(warm[1] - warm[0])[:, None], d], axis=1).cumsum(axis=1)
            d = d1
        if order:
            d = np.concatenate([warm[0][:, None], d], axis=1).cumsum(axis=1)
        out[rows] = d
    if not np.isin(kind, (2, 16, 18, 20)).all():
        raise NotImplementedError
    return out


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams (8-bit mono): frame checksums, header checksums and MD5 are verified."""
    out: list[bytes | None] = [None] * len(streams)
    fast, starts, ends, heads, owner, infos, base = [], [], [], [], [], [], 0
    for i, s in enumerate(streams):
        info, _, first = metadata(s)
        infos.append(info)
        flat = np.frombuffer(s, np.uint8)
        at = _frame_starts(flat, first, info["samples"] // BLOCK) if info["block"] == (BLOCK, BLOCK) and info["bits"] == 8 and info["channels"] == 1 and info["samples"] % BLOCK == 0 else None
        if at is None or not len(at):
            out[i] = scalar_decode(s)
            continue
        fast.append(i)
        starts.append(at + base)
        ends.append(np.append(at[1:], len(s)) + base)
        heads.append(np.array([len(frame_header(n)) for n in range(len(at))]))
        owner.append(s)
        base += len(s)
    if fast:
        flat = np.frombuffer(b"".join(owner), np.uint8)
        st, en, he = np.concatenate(starts), np.concatenate(ends), np.concatenate(heads)
        try:
            rows = np.concatenate([_decode_batch(flat, st[s : s + BATCH], en[s : s + BATCH], he[s : s + BATCH]) for s in range(0, len(st), BATCH)])
            data = rows.astype(np.int8).tobytes()
            at = 0
            for i, own in zip(fast, starts, strict=True):
                signed = data[at : at + len(own) * BLOCK]
                at += len(signed)
                if hashlib.md5(signed).digest() != infos[i]["md5"]:
                    raise Corrupt("stream MD5")
                out[i] = (np.frombuffer(signed, np.uint8) ^ np.uint8(128)).tobytes()
        except NotImplementedError:
            for i in fast:
                out[i] = scalar_decode(streams[i])
    return out  # type: ignore[return-value]


class Bits:
    """Bits of a stream, most significant first."""

    def __init__(self, data: bytes, at: int):
        self.data, self.pos = data, at * 8

    def take(self, n: int) -> int:
        a, b = self.pos // 8, (self.pos + n + 7) // 8
        if b > len(self.data):
            raise Corrupt("the stream ends early")
        v = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.pos - n)
        self.pos += n
        return v & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _residual(bits: Bits, order: int, block: int) -> list[int]:
    wide = 5 if bits.take(2) else 4
    parts, out = bits.take(4), []
    for i in range(1 << parts):
        n = (block >> parts) - (order if i == 0 else 0)
        k = bits.take(wide)
        if k == (1 << wide) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                z = bits.unary() << k | bits.take(k)
                out.append(z >> 1 ^ -(z & 1))
    return out


#: Coefficients of the format's fixed predictors of order 0 to 4.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframe(bits: Bits, block: int, depth: int) -> list[int]:
    bits.take(1)
    kind = bits.take(6)
    wasted = 1 + bits.unary() if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * block
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        coef, shift = FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            coef = tuple(bits.signed(precision) for _ in range(order))
        for r in _residual(bits, order, block):
            out.append(r + (sum(c * out[-1 - j] for j, c in enumerate(coef)) >> shift))
    else:
        raise Corrupt("reserved subframe")
    return [v << wasted for v in out] if wasted else out


def scalar_frames(stream: bytes, at: int, info: dict) -> Iterator[tuple[int, list[list[int]]]]:
    """(offset after the frame, samples of each channel) of the frames from an offset on, one sample at a time; checksums are verified."""
    while at < len(stream):
        bits = Bits(stream, at)
        if bits.take(15) != 0x7FFC:
            raise Corrupt("lost synchronisation")
        bits.take(1)
        size, rate, layout, depth = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        bits.take(1)
        lead = bits.take(8)
        while lead & 0x80 and lead & 0x40:
            bits.take(8)
            lead = lead << 1 & 0xFF
        if not size or layout > 10 or depth == 3:
            raise Corrupt("reserved header value")
        block = 192 if size == 1 else 576 << size - 2 if size <= 5 else bits.take(8) + 1 if size == 6 else bits.take(16) + 1 if size == 7 else 256 << size - 8
        if rate >= 12:
            bits.take(8 if rate == 12 else 16)
        if crc8(stream[at : bits.pos // 8]) != bits.take(8):
            raise Corrupt("header checksum")
        depth = info["bits"] if not depth else (8, 12, None, 16, 20, 24, 32)[depth - 1]
        # the side channel of a decorrelated pair has one bit more
        side = {8: 1, 9: 0, 10: 1}.get(layout)
        chans = [_subframe(bits, block, depth + (c == side)) for c in range(2 if side is not None else layout + 1)]
        if layout == 8:
            chans[1] = [a - d for a, d in zip(*chans, strict=True)]
        elif layout == 9:
            chans[0] = [d + b for d, b in zip(*chans, strict=True)]
        elif layout == 10:
            mids = [m << 1 | d & 1 for m, d in zip(*chans, strict=True)]
            chans = [[(m + d) >> 1 for m, d in zip(mids, chans[1], strict=True)], [(m - d) >> 1 for m, d in zip(mids, chans[1], strict=True)]]
        end = (bits.pos + 7) // 8
        body = np.frombuffer(stream[at:end], np.uint8)
        if int(crc16_rows(body, np.array([0]), np.array([len(body)]))[0]) != int.from_bytes(stream[end : end + 2], "big"):
            raise Corrupt("frame checksum")
        at = end + 2
        yield at, chans


def pcm(chans: list[list[int]], bits: int) -> bytes:
    """Interleaved signed little-endian samples, in whole bytes."""
    width = (bits + 7) // 8
    flat = np.array(chans, np.int64).T.ravel()
    return flat.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decoded(stream: bytes) -> tuple[dict, bytes]:
    """(information, PCM) of any stream; the MD5 is verified if the stream states one."""
    info, _, at = metadata(stream)
    data = b"".join(pcm(chans, info["bits"]) for _, chans in scalar_frames(stream, at, info))
    if info["md5"] != bytes(16) and hashlib.md5(data).digest() != info["md5"]:
        raise Corrupt("stream MD5")
    return info, data


def scalar_decode(stream: bytes) -> bytes:
    """The payload of an 8-bit stream: its samples as bytes (plus 128)."""
    info, data = decoded(stream)
    if info["bits"] != 8:
        raise Corrupt("only 8-bit samples become bytes")
    return (np.frombuffer(data, np.uint8) ^ np.uint8(128)).tobytes()


def read_from(stream: bytes, sample: int, count: int | None = None) -> bytes:
    """PCM from a sample on, ``count`` samples or all; entered through the seek table and left as soon as they are there."""
    info, seek, first = metadata(stream)
    at, offset, _ = max((p for p in seek if p[0] <= sample), default=(0, 0, 0))
    frame = info["channels"] * ((info["bits"] + 7) // 8)
    stop = None if count is None else (sample + count - at) * frame
    out, held = [], 0
    for _, chans in scalar_frames(stream, first + offset, info):
        out.append(pcm(chans, info["bits"]))
        held += len(out[-1])
        if stop is not None and held >= stop:
            break
    return b"".join(out)[(sample - at) * frame : stop]


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b"\xff" * ((-len(data)) % BLOCK or (0 if data else BLOCK))


def features(samples: np.ndarray) -> str:
    """Peak, mean square and zero crossings of the samples, as integers."""
    x = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{int(np.abs(x).max())}:{int((x * x).sum() // len(x))}:{crossings}"


#: Bytes of payload handled together, and samples of a PCM block: as many as lie between two points of the seek table.
GROUP, SAMPLES = 1 << 21, 64 * BLOCK


def pcm_blocks(media: DataFrame, stream: str = "media", carry: tuple[str, ...] = ("doc_id",), samples: int = SAMPLES) -> DataFrame:
    """Streams decoded into PCM blocks: carry columns, first_sample, n_samples, byte_offset, pcm.

    Every block but the last holds ``samples`` samples of all channels, interleaved, signed, little-endian;
    byte_offset is where it stands in the whole stream's PCM, so a reader goes to a sample by one comparison.
    Checksums and the MD5 are verified; a damaged stream fails the job.  Null streams have no blocks; rows
    repeat as they come.
    """
    src = media.select(*carry, media[stream].alias("__stream"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*carry).schema) + ", first_sample long, n_samples long, byte_offset long, pcm binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in enumerate(batch.column(len(carry))):
                raw = value.as_py()
                if raw is None:
                    continue
                info, _, _ = metadata(raw)
                if info["bits"] == 8 and info["channels"] == 1 and info["block"] == (BLOCK, BLOCK):
                    data = (np.frombuffer(decode_streams([raw])[0], np.uint8) ^ np.uint8(128)).tobytes()
                else:
                    data = decoded(raw)[1]
                frame = info["channels"] * ((info["bits"] + 7) // 8)
                cuts = list(range(0, len(data), samples * frame))
                parts = [data[c : c + samples * frame] for c in cuts]
                own = pa.array(np.full(len(cuts), row))
                same = [batch.column(i).take(own) for i in range(len(carry))]
                cols = [pa.array([c // frame for c in cuts], pa.int64()), pa.array([len(p) // frame for p in parts], pa.int64()), pa.array(cuts, pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays([*same, *cols], names=[*carry, "first_sample", "n_samples", "byte_offset", "pcm"])

    return src.mapInArrow(run, schema)


def media(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), stored: bool = False) -> DataFrame:
    """Each whole text stored as a FLAC stream and read back.

    Adds n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and with
    ``stored`` the stream itself.  Everything but n_bytes and the media columns comes from the decoded
    samples.  Null and empty texts become one block of 255; equal texts give equal values.
    """
    src = docs.select(*carry, docs[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) + ", n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * stored

    def groups(column: pa.Array) -> Iterator[list[tuple[int, bytes]]]:
        part, size = [], 0
        for t in column:
            part.append(padded(t.as_py()))
            size += len(part[-1][1])
            if size >= GROUP:
                yield part
                part, size = [], 0
        if part:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, at = batch.schema.names[:-1], 0
            for part in groups(batch.column(len(names))):
                streams = encode_streams([p for _, p in part])
                back = decode_streams(streams)
                cols = [batch.column(i).slice(at, len(part)) for i in range(len(names))]
                at += len(part)
                cols += [pa.array([n for n, _ in part], pa.int64()), pa.array(map(len, back), pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()), pa.array([zlib.crc32(b[-32:]) for b in back], pa.int64()), pa.array(map(len, streams), pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams], pa.string()), pa.array([features(np.frombuffer(b, np.uint8)) for b in back], pa.string())]
                extra = [pa.array(streams, pa.binary())] if stored else []
                yield pa.RecordBatch.from_arrays(cols + extra, names=[*names, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * stored])

    return src.mapInArrow(run, schema)
