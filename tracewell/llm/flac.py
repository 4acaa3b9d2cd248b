"""FLAC: texts stored as 8-bit mono audio without loss, and streams decoded to PCM blocks with sample offsets.

Frames are independent, so both directions work on many frames at once: numpy arrays have one lane for each frame, and
one step for each sample. The encoder picks a fixed linear predictor and Rice parameters, or keeps samples verbatim;
the decoder reads constant, verbatim, fixed and general linear prediction subframes, Rice partitions with either
parameter size and escaped partitions, and checks both checksums of a frame. Lanes begin at the stream's seek points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import appended, table

BLOCK = 1152
UNIT = 192
RATE = 8000
#: Frames that are coded at once; memory is about 100 bytes for each of their samples.
LANES = 4096
#: Seek points of a stream at most; beyond, each stands for several frames.
POINTS = 65_536

# Fixed values of the format: block sizes by code, coefficients of the fixed predictors.
SIZES = {1: 192, **{2 + k: 576 << k for k in range(4)}, **{8 + k: 256 << k for k in range(8)}}
CODES = {n: c for c, n in SIZES.items()}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    pass


@cache
def crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    for k in range(256):
        c = k << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
        out[k] = c
    return out


def crc8(data: bytes) -> int:
    t, c = crc_table(0x07, 8), 0
    for b in data:
        c = int(t[c ^ b])
    return c


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of many pieces of data, all at once."""
    t = crc_table(0x8005, 16)
    order = np.argsort(-sizes, kind="stable")
    at, left, c = starts[order], sizes[order], np.zeros(len(sizes), dtype=np.int64)
    live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for k, n in enumerate(live):
        c[:n] = (c[:n] << 8 & 0xFFFF) ^ t[c[:n] >> 8 ^ data[at[:n] + k]]
    out = np.empty_like(c)
    out[order] = c
    return out


@cache
def number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = 1
    while n >> (6 * tail + 6 - tail):
        tail += 1
    lead = (0xFF << (7 - tail) & 0xFF) | n >> (6 * tail)
    return bytes([lead, *(0x80 | n >> (6 * k) & 0x3F for k in reversed(range(tail)))])


def frame_header(n: int, size: int) -> bytes:
    code = CODES.get(size, 7)
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0 << 4 | 1 << 1]) + number(n) + ((size - 1).to_bytes(2, "big") if code == 7 else b"")
    return head + bytes([crc8(head)])


cached_header = cache(frame_header)


def encode_lanes(x: np.ndarray, numbers: list[int], partition_order: int = 0, general: bool = False) -> list[bytes]:
    """Frames of one size: x has a row of signed 8-bit samples for each. general: writes predictors in their general form."""
    lanes, n = x.shape
    x = x.astype(np.int32)
    best, price = np.zeros(lanes, dtype=np.int64), np.abs(x[:, 4:]).sum(axis=1)
    res, diff = x.copy(), x
    for order in range(1, 5):
        diff = np.diff(diff, axis=1)
        cost = np.abs(diff[:, 4 - order :]).sum(axis=1)
        if (better := cost < price).any():
            best[better], price[better] = order, cost[better]
            res[better, order:] = diff[better]
    u = np.where(res < 0, -2 * res - 1, 2 * res)
    column = np.arange(n)
    coded = column[None, :] >= best[:, None]
    u[~coded] = 0
    parts = 1 << partition_order
    blocks = u.reshape(lanes, parts, n // parts)
    inside = coded.reshape(lanes, parts, n // parts).sum(axis=2)
    mean = blocks.sum(axis=2) / np.maximum(inside, 1)
    guess = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, 14).astype(np.int64)
    k, bits = guess, None
    for d in (-1, 0, 1):
        try_ = np.clip(guess + d, 0, 14)
        b = inside * (try_ + 1) + (blocks >> try_[:, :, None]).sum(axis=2)
        k, bits = (try_, b) if bits is None else (np.where(b < bits, try_, k), np.minimum(b, bits))
    kk = np.repeat(k, n // parts, axis=1)
    lpc = best if general else np.zeros_like(best)
    extra = np.where(lpc > 0, 9 + 5 * lpc, 0)  # precision, shift and coefficients
    plain = bits.sum(axis=1) + 8 * best + extra + 6 + 4 * parts >= 8 * n
    constant = (x == x[:, :1]).all(axis=1)
    plain &= ~constant
    rice = ~plain & ~constant

    # Fields of a frame after its header, as (value, bits): type, warm-up samples, predictor, method, then codes with their parameters.
    kind = np.where(constant, 0, np.where(plain, 1, np.where(lpc > 0, 0x20 | np.maximum(best - 1, 0), 8 | best))) << 1
    wide = 1 + 4 + 6 + 1
    value, size = np.zeros((lanes, wide + n + parts), dtype=np.int64), np.zeros((lanes, wide + n + parts), dtype=np.int64)
    value[:, 0], size[:, 0] = kind, 8
    value[:, 1:5] = x[:, :4] & 0xFF
    size[:, 1:5] = np.where(rice[:, None] & (np.arange(4)[None, :] < best[:, None]), 8, 0)
    if general:
        coefs = np.zeros((5, 4), dtype=np.int64)
        for order, c in enumerate(FIXED):
            coefs[order, : len(c)] = c
        on = rice & (best > 0)
        value[:, 5], size[:, 5] = 4, np.where(on, 4, 0)
        size[:, 6] = np.where(on, 5, 0)
        value[:, 7:11] = coefs[best] & 0x1F
        size[:, 7:11] = np.where(on[:, None] & (np.arange(4)[None, :] < best[:, None]), 5, 0)
    value[:, 11], size[:, 11] = partition_order, np.where(rice, 6, 0)
    q, r = u >> kk, u & ((1 << kk) - 1)
    code = np.where(rice[:, None], 1 << kk | r, x & 0xFF)
    long = np.where(rice[:, None], np.where(coded, q + 1 + kk, 0), np.where(constant[:, None], np.where(column[None, :] == 0, 8, 0), 8))
    # each partition's codes stand behind its parameter
    v3, s3 = value[:, wide:].reshape(lanes, parts, n // parts + 1), size[:, wide:].reshape(lanes, parts, n // parts + 1)
    v3[:, :, 0], s3[:, :, 0] = k, np.where(rice, 4, 0)[:, None]
    v3[:, :, 1:], s3[:, :, 1:] = code.reshape(blocks.shape), long.reshape(blocks.shape)

    heads = [cached_header(i, n) for i in numbers]
    head_size = np.array([len(h) for h in heads], dtype=np.int64)
    ends = np.cumsum(size, axis=1)
    total = head_size + (ends[:, -1] + 7 >> 3) + 2
    first = np.concatenate([[0], np.cumsum(total)])
    used = size > 0
    at = (ends + (first[:-1] + head_size)[:, None] * 8 - 1)[used]
    bits_ = value[used] << (7 - (at & 7))
    at >>= 3
    buffer = np.zeros(first[-1] + 2, dtype=np.int64)
    for back in range(3):
        buffer += np.bincount(at + 2 - back, weights=(bits_ >> 8 * back & 0xFF).astype(np.float64), minlength=len(buffer)).astype(np.int64)
    data = buffer[2:].astype(np.uint8)
    for i, h in enumerate(heads):
        data[first[i] : first[i] + len(h)] = np.frombuffer(h, dtype=np.uint8)
    c = crc16(data, first[:-1], total - 2)
    data[first[1:] - 2], data[first[1:] - 1] = c >> 8, c & 0xFF
    raw = data.tobytes()
    return [raw[first[i] : first[i + 1]] for i in range(lanes)]


def encode(payloads: list[bytes], block: int = BLOCK, partition_order: int = 0, general: bool = False) -> list[bytes]:
    """A FLAC stream with seek points for each payload, whose bytes are samples plus 128."""
    frames: list[list[bytes]] = [[b""] * -(-len(p) // block) for p in payloads]
    by_size: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for j in range(len(frames[i])):
            by_size.setdefault(min(block, len(p) - j * block), []).append((i, j))
    for size, todo in by_size.items():
        order = partition_order if size % (1 << partition_order) == 0 and size >> partition_order > 4 else 0
        for k in range(0, len(todo), LANES):
            some = todo[k : k + LANES]
            raw = b"".join(payloads[i][j * block : j * block + size] for i, j in some)
            x = np.frombuffer(raw, dtype=np.uint8).reshape(len(some), size).astype(np.int16) - 128
            for (i, j), f in zip(some, encode_lanes(x, [j for _, j in some], order, general), strict=True):
                frames[i][j] = f
    out = []
    for p, fs in zip(payloads, frames, strict=True):
        sizes = [len(f) for f in fs]
        samples = (np.frombuffer(p, dtype=np.uint8) ^ 0x80).tobytes()
        info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(samples, usedforsecurity=False).digest()
        stride = -(-len(fs) // POINTS)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        seek = b"".join((j * block).to_bytes(8, "big") + int(offsets[j]).to_bytes(8, "big") + min(block, len(p) - j * block).to_bytes(2, "big") for j in range(0, len(fs), stride))
        out.append(b"".join([b"fLaC", b"\x00" + len(info).to_bytes(3, "big"), info, b"\x83" + len(seek).to_bytes(3, "big"), seek, *fs]))
    return out


def stream_info(data: bytes) -> dict:
    """What the metadata blocks say, with the byte where frames begin and the seek points (sample, byte)."""
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, info, points = 4, False, {}, []
    while not last:
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            word = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[2:4], "big"), "rate": word >> 44, "channels": (word >> 41 & 7) + 1, "bits": (word >> 36 & 31) + 1, "samples": word & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            points = [(int.from_bytes(body[k : k + 8], "big"), int.from_bytes(body[k + 8 : k + 16], "big")) for k in range(0, size, 18)]
        at += 4 + size
    if not info or info["channels"] != 1 or info["bits"] > 16:
        raise FlacError("only mono streams of up to 16 bits are read")
    points = sorted({p for p in points if p[0] < info["samples"]})
    return info | {"at": at, "points": points if points and points[0] == (0, 0) else [(0, 0), *points]}


def header_at(data: memoryview, at: int, info: dict) -> tuple[int, int]:
    """Samples of the frame at a byte and the byte after its header."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame where one should be")
    code, rate, end = data[at + 2] >> 4, data[at + 2] & 15, at + 5
    lead = data[at + 4]
    while lead & 0xC0 == 0xC0:
        lead, end = lead << 1 & 0xFF, end + 1
    if code == 6:
        size, end = data[end] + 1, end + 1
    elif code == 7:
        size, end = int.from_bytes(data[end : end + 2], "big") + 1, end + 2
    else:
        size = SIZES[code]
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if cached_crc8(bytes(data[at:end])) != data[end]:
        raise FlacError("checksum of a frame's header")
    return size, end + 1


cached_crc8 = cache(crc8)


class Bits:
    """A buffer that is read at many places at once."""

    def __init__(self, raw: np.ndarray):
        b = np.concatenate([raw, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
        self.words = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]

    def window(self, at: np.ndarray) -> np.ndarray:
        """The next 25 bits or more, at the top of 32."""
        return self.words[at >> 3] << (at & 7).astype(np.uint32)

    def get(self, at: np.ndarray, n) -> np.ndarray:
        """n bits (an int or an array of them, up to 24)."""
        n = np.asarray(n, dtype=np.int64)
        return np.where(n > 0, self.window(at).astype(np.int64) >> (32 - n), 0)

    def signed(self, at: np.ndarray, n) -> np.ndarray:
        v, n = self.get(at, n), np.asarray(n, dtype=np.int64)
        return np.where(v >> np.maximum(n - 1, 0) & (n > 0), v - (1 << n), v)

    def rice(self, at: int, k: int) -> tuple[int, int]:
        """One code of any length and the place after it."""
        q = 0
        while not (w := int(self.window(np.array([at]))[0]) >> 7):
            q, at = q + 25, at + 25
        z = 25 - w.bit_length()
        at += z + 1
        return (q + z) << k | int(self.get(np.array([at]), k)[0]), at + k


def decode_lanes(bits: Bits, at: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples (a row for each lane) of the subframes at these bits, and the bits after them; n: samples of each, descending."""
    lanes, most = len(n), int(n[0])
    kind = bits.get(at, 8)
    if (kind & 0x81).any():
        raise FlacError("reserved or wasted bits in a subframe")
    kind >>= 1
    pos = at + 8
    out = np.zeros((lanes, most), dtype=np.int64)
    order = np.where(kind >= 32, (kind & 31) + 1, np.where((kind >= 8) & (kind <= 12), kind & 7, 0))
    coded = (kind >= 32) | (kind >= 8) & (kind <= 12)
    for i in np.flatnonzero(kind == 0):
        out[i, : n[i]] = bits.signed(pos[i : i + 1], width)[0]
        pos[i] += width
    for i in np.flatnonzero(kind == 1):
        out[i, : n[i]] = bits.signed(pos[i] + width * np.arange(n[i]), width)
        pos[i] += width * n[i]
    if not (coded | (kind <= 1)).all():
        raise FlacError("reserved kind of subframe")
    own = np.flatnonzero(coded)
    if not len(own):
        return out, pos
    n_, order, at = n[own], order[own], pos[own]
    deep = int(order.max())
    x = np.zeros((most + deep, len(own)), dtype=np.int64)
    for i in range(deep):
        warm = order > i
        x[deep + i] = np.where(warm, bits.signed(at, width), 0)
        at = at + np.where(warm, width, 0)
    coef, shift = np.zeros((max(deep, 1), len(own)), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
    for j, o in enumerate(order):
        if kind[own[j]] >= 32:
            p = int(bits.get(at[j : j + 1], 4)[0]) + 1
            shift[j] = bits.signed(at[j : j + 1] + 4, 5)[0]
            coef[:o, j] = bits.signed(at[j] + 9 + p * np.arange(o), p)
            at[j] += 9 + p * o
        else:
            coef[:o, j] = FIXED[o]
    wide = 4 + bits.get(at, 2)
    parts = bits.get(at + 2, 4)
    at = at + 6
    # the steps at which lanes begin a partition
    begins: dict[int, list[int]] = {}
    for j in range(len(own)):
        step = int(n_[j]) >> int(parts[j])
        for b in (range(0, int(n_[j]), step) if parts[j] else (0,)):
            begins.setdefault(max(b, int(order[j])), []).append(j)
    starts = {s: np.array(js) for s, js in begins.items()}
    k, raw = np.zeros(len(own), dtype=np.int64), np.full(len(own), -1, dtype=np.int64)
    live = np.searchsorted(-n_, -np.arange(most), side="left")
    escaped, plain = False, deep == 0
    settled = int(order.max())
    for i in range(most):
        if (js := starts.get(i)) is not None:
            k[js] = bits.get(at[js], wide[js])
            at[js] += wide[js]
            raw[js] = -1
            if (esc := js[k[js] == (1 << wide[js]) - 1]).size:
                raw[esc] = bits.get(at[esc], 5)
                at[esc] += 5
                k[esc] = 0
            escaped = bool((raw >= 0).any())
        a = live[i]
        here, kk = at[:a], k[:a]
        w = bits.window(here)
        q = 32 - np.frexp(w.astype(np.float64))[1].astype(np.int64)
        end = q + 1 + kk
        u = q << kk | w.astype(np.int64) >> np.maximum(32 - end, 0) & (1 << kk) - 1
        if escaped or i < settled:
            busy = order[:a] <= i
            far = np.flatnonzero((end > 25) & busy & (raw[:a] < 0))
        else:
            busy, far = None, np.flatnonzero(end > 25)
        for j in far:
            u[j], new = bits.rice(int(here[j]), int(kk[j]))
            end[j] = new - here[j]
        r = u >> 1 ^ -(u & 1)
        if escaped:
            on = raw[:a] >= 0
            r, end = np.where(on, bits.signed(here, np.maximum(raw[:a], 0)), r), np.where(on, raw[:a], end)
        if not plain:
            r += (coef[:, :a] * x[i : i + deep, :a][::-1]).sum(axis=0) >> shift[:a]
        if busy is not None:
            r, end = np.where(busy, r, x[deep + i, :a]), np.where(busy, end, 0)
        x[deep + i, :a] = r
        at[:a] = here + end
    out[own] = x[deep:].T
    pos[own] = at
    return out, pos


def decode(streams: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """(sample offset, byte offset, samples) of each frame of each stream; a checksum or length that is wrong raises FlacError."""
    infos = [stream_info(s) for s in streams]
    out: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in streams]
    width = {i["bits"] for i in infos}
    todo = []
    for s, info in enumerate(infos):
        ends = [p[0] for p in info["points"][1:]] + [info["samples"]]
        todo += [(s, sample, info["at"] + byte, end) for (sample, byte), end in zip(info["points"], ends, strict=True) if sample < end]
    for bits_wide in width:
        own = [t for t in todo if infos[t[0]]["bits"] == bits_wide]
        while own:
            batch, own = own[:LANES], own[LANES:]
            own = decode_batch(streams, infos, batch, bits_wide, out) + own
    for info, blocks in zip(infos, out, strict=True):
        blocks.sort(key=lambda b: b[0])
        if sum(len(b[2]) for b in blocks) != info["samples"]:
            raise FlacError("samples are missing")
        if any(info["md5"]):
            kind = np.int8 if info["bits"] <= 8 else np.dtype("<i2")
            if hashlib.md5(b"".join(b[2].astype(kind).tobytes() for b in blocks), usedforsecurity=False).digest() != info["md5"]:
                raise FlacError("checksum of the samples")
    return out


def decode_batch(streams: list[bytes], infos: list[dict], batch: list[tuple], width: int, out: list) -> list[tuple]:
    """Decodes one frame of each lane (stream, sample, byte, end); gives the lanes that go on."""
    heads = []
    for s, sample, at, end in batch:
        size, body = header_at(memoryview(streams[s]), at, infos[s])
        heads.append((size, s, sample, at, body, end))
    heads.sort(key=lambda h: -h[0])
    # a frame is as long as its samples verbatim and some bytes more, or it is cut out again
    spare, done = 64, False
    while not done:
        cut = [streams[s][at : at + (size * width >> 3) + (body - at) + spare] for size, s, _, at, body, _ in heads]
        first = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
        data = np.frombuffer(b"".join(cut), dtype=np.uint8)
        starts = (first[:-1] + np.array([h[4] - h[3] for h in heads])) * 8
        samples, pos = decode_lanes(Bits(data), starts, np.array([h[0] for h in heads]), width)
        stop = pos + 7 >> 3
        whole = [h[3] + len(c) >= len(streams[h[1]]) for h, c in zip(heads, cut, strict=True)]
        done = bool(((stop + 2 <= first[1:]) | whole).all())
        spare *= 16
    if (stop + 2 > first[1:]).any():
        raise FlacError("a frame is cut short")
    sums = crc16(data, first[:-1], stop - first[:-1])
    if (sums != (data[stop].astype(np.int64) << 8 | data[stop + 1])).any():
        raise FlacError("checksum of a frame")
    more = []
    for j, (size, s, sample, at, _, end) in enumerate(heads):
        out[s].append((sample, at - infos[s]["at"], samples[j, :size].copy()))
        if sample + size < end:
            more.append((s, sample + size, at + int(stop[j] + 2 - first[j]), end))
    return more


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def feature(blocks: list[tuple[int, int, np.ndarray]]) -> str:
    """Blocks, peak, energy and sign changes of the decoded samples."""
    x = np.concatenate([b[2] for b in blocks])
    return f"blocks={len(blocks)};peak={int(np.abs(x).max())};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def portions(texts: list[str | None], most: int = LANES * BLOCK) -> Iterator[list[str | None]]:
    """Runs of texts of about so many bytes."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "") + UNIT
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MEDIA = "media binary, blocks array<struct<sample_offset:long,byte_offset:long,pcm:binary>>"


def store_flac(docs: DataFrame, column: str = "text", media: bool = True) -> DataFrame:
    """docs with each text's UTF-8 bytes, padded with spaces to a positive multiple of 192, as a FLAC stream that is read back.

    media: gives the stream and its PCM blocks with sample and byte offsets, besides the digests, of which payload and
    feature come from the decoded blocks. A null text is empty. Equal texts give equal values; rows repeat as in docs,
    and columns of docs with the new names are replaced.
    """

    def work(texts):
        columns: list[list] = [[] for _ in range(9 if media else 7)]
        for some in portions(texts):
            given = [payload(t) for t in some]
            streams = encode([p for _, p in given])
            for (n, _), stream, blocks in zip(given, streams, decode(streams), strict=True):
                pcm = [(b[2] + 128).astype(np.uint8).tobytes() for b in blocks]
                back = b"".join(pcm)
                row = [n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(blocks)]
                if media:
                    row += [stream, [{"sample_offset": b[0], "byte_offset": b[1], "pcm": p} for b, p in zip(blocks, pcm, strict=True)]]
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
        return columns

    return appended(docs, f"{DIGESTS}, {MEDIA}" if media else DIGESTS, work, column)


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_flac(table(spark, sf_dir, "documents").select("doc_id", "text"), media=False).drop("text")
