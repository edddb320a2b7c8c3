"""Media columns: byte payloads in MPEG audio streams, and a reader of such streams.

write_stream makes an MPEG-1 Layer III stream: an ID3v2.3 tag that states the payload's length, a first frame with a
Xing table (frames, bytes, 100 seek points), then frames of varying bit rate whose side information is all zero (silence)
and whose remaining bytes carry the payload as ancillary data. Each frame's CRC-16 covers its header and side
information.

read_stream takes any bytes: it reads tags of versions 2.2 to 2.4 and 1 (at the end only where no frame goes on across
the tag's start), resynchronises on frame headers (a header counts if the next one agrees, or the stream ends there),
reads Xing, Info and VBRI tables with their seek points, verifies the checksums of all three layers, and returns exact
durations in samples, seek offsets and the ancillary payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.session import ready

# Fixed values of the MPEG audio standard: bit rates in kbit/s by (version 1?, layer), sampling rates of version 1.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
# Bits of an allocation in layer II as (bits, subbands), by table; the last is that of versions 2 and 2.5.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}
#: Every SEEK-th frame's offset is stored.
SEEK = 64
_RATE, _SIDE = 1, 17  # 48 kHz, mono


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return out


_TABLE = _crc_table()


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """The CRC-16 of MPEG audio frames: polynomial 8005, start FFFF."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _TABLE[(c >> 8) ^ b]
    return c


@lru_cache(65536)
def header(four: bytes) -> tuple[int, int, int, int, bool, int] | None:
    """(frame bytes, samples, sampling rate, side information bytes, has CRC, kbit/s) of a frame header, or None."""
    h = int.from_bytes(four, "big")
    version, layer, rate, sampling = h >> 19 & 3, 4 - (h >> 17 & 3), h >> 12 & 15, h >> 10 & 3
    if h >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or sampling == 3 or h & 3 == 2:
        return None
    first = version == 3
    kbit, hertz, pad = BITRATES[first, layer][rate], RATES[sampling] >> (0 if first else 1 if version == 2 else 2), h >> 9 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
    size = (12000 * kbit // hertz + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hertz + pad
    mono = h >> 6 & 3 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return size, samples, hertz, side, not h >> 16 & 1, kbit


def _bits_crc(data: bytes, bits: int) -> int:
    """crc16 of the first bits of data."""
    c = crc16(data[: bits // 8])
    for k in range(bits % 8):
        top = (c >> 15) ^ (data[bits // 8] >> (7 - k) & 1)
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


def _protected(h: int, body: bytes) -> int:
    """How many bits of a layer I or II frame's body its checksum covers: bit allocations, and in layer II the scale
    factor selections of subbands that have any."""
    first, layer, mode = h >> 19 & 3 == 3, 4 - (h >> 17 & 3), h >> 6 & 3
    channels = 1 if mode == 3 else 2
    bound = 4 * (h >> 4 & 3) + 4 if mode == 1 else 32
    if layer == 1:
        return 4 * (channels * min(bound, 32) + max(0, 32 - bound))
    kbit, hertz = BITRATES[first, 2][h >> 12 & 15] // channels, RATES[h >> 10 & 3]
    name = "low" if not first else ("d" if hertz == 32000 else "c") if kbit < 56 else "a" if hertz == 48000 or kbit <= 80 else "b"
    widths = [bits for bits, n in ALLOCATION[name] for _ in range(n)]
    value, size, at, chosen = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 512, 0, 0
    for k, bits in enumerate(widths):
        for _ in range(channels if k < bound else 1):
            chosen += (value >> (size - at - bits) & ((1 << bits) - 1) > 0) * (1 if k < bound else channels)
            at += bits
    return at + 2 * chosen


def _checksum(data: bytes, at: int, size: int, side: int) -> bool:
    """Whether the checksum of the frame at a place is right."""
    body = data[at + 6 : at + size]
    bits = 8 * side or _protected(int.from_bytes(data[at : at + 4], "big"), body)
    return _bits_crc(data[at + 2 : at + 4] + body, 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")


def _text(value: bytes) -> str:
    """The text of a tag's frame by its encoding byte."""
    name = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0] if value else 0, "latin-1")
    return value[1:].decode(name, "replace")


def _sum_of(data: bytes, bits: int) -> int:
    n = 0
    for b in data:
        n = n << bits | b
    return n


def read_tag(data: bytes, at: int) -> tuple[int, list[tuple[str, bytes]]]:
    """The end of the ID3v2 tag at a place, and its frames (name, value)."""
    version, flags, size = data[at + 3], data[at + 5], _sum_of(data[at + 6 : at + 10], 7)
    body, end = data[at + 10 : at + 10 + size], at + 10 + size + (10 if version >= 4 and flags & 0x10 else 0)
    if version < 4 and flags & 0x80:
        body = body.replace(b"\xff\x00", b"\xff")
    k = 0
    if version >= 3 and flags & 0x40:
        k = _sum_of(body[:4], 7) if version >= 4 else 4 + _sum_of(body[:4], 8)
    name, width, head = (3, 3, 6) if version == 2 else (4, 4, 10)
    out = []
    while k + head <= len(body) and body[k]:
        n = _sum_of(body[k + name : k + name + width], 7 if version >= 4 else 8)
        out.append((body[k : k + name].decode("latin-1"), body[k + head : k + head + n]))
        k += head + n
    return end, out


@lru_cache(16)
def _head(rate: int) -> tuple[bytes, int]:
    """Header, checksum and empty side information at a bit rate; bytes of payload behind them."""
    h = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | rate << 12 | _RATE << 10 | 3 << 6)
    side = bytes(_SIDE)
    return h + struct.pack(">H", crc16(h[2:] + side)) + side, header(h)[0] - 6 - _SIDE


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def write_stream(payload: bytes) -> bytes:
    """payload as an MPEG audio stream; read_stream gives it back."""
    text = b"\x00payload\x00" + str(len(payload)).encode()
    frame = b"TXXX" + struct.pack(">I", len(text)) + b"\x00\x00" + text
    tag = b"ID3\x03\x00\x00" + _synchsafe(len(frame)) + frame
    rooms = [(rate, _head(rate)[1]) for rate in range(1, 15)]
    frames, at = [], 0
    while at < len(payload):
        rate, room = next((x for x in rooms if x[1] >= len(payload) - at), rooms[-1])
        frames.append(_head(rate)[0] + payload[at : at + room].ljust(room, b"\x00"))
        at += room
    offsets, total = [], 0
    first, room = _head(9)
    total = len(first) + room
    for x in frames:
        offsets.append(total)
        total += len(x)
    toc = bytes(offsets[k * len(offsets) // 100] * 256 // total if offsets else 0 for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return b"".join((tag, first, table.ljust(room, b"\x00"), *frames))


def read_stream(data: bytes) -> dict:
    """What a stream holds: payload, frames, samples, sampling rate, duration in microseconds, bytes skipped, checksums
    right and wrong, table (kind, frames, bytes, seek points), tags, offsets of every SEEK-th frame, bit rates seen.

    Bytes that are no frame are skipped and counted; a stream without frames has 0 of all.
    """
    at, end, tags, stated = 0, len(data), [], None
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at, frames_of = read_tag(data, at)
        for name, value in frames_of:
            tags.append((name, _text(value)))
            if value.startswith(b"\x00payload\x00") and value[9:].isdigit():
                stated = int(value[9:])
    mark = end - 128 if data[-128:-125] == b"TAG" and end - 128 >= at else end  # a tag, or payload of a frame across it
    parts, seeks, rates = [], [], set()
    frames = samples = skipped = right = wrong = hertz = 0
    table, locked = ("", 0, 0, b""), False
    while at + 4 <= end and at != mark:
        h = header(data[at : at + 4])
        fits = h is not None and at + h[0] <= end
        if fits and (not locked or at < mark < at + h[0]):
            behind = at + h[0]
            fits = behind + 4 > end or behind == mark or header(data[behind : behind + 4]) is not None
        if not fits:
            stop = mark if at < mark else end
            after = data.find(b"\xff", at + 1, stop)
            skipped += (after if after >= 0 else stop) - at
            at, locked = after if after >= 0 else stop, False
            continue
        locked = True
        size, count, hertz, side, has_crc, kbit = h
        start = at + 4 + 2 * has_crc
        if has_crc:
            good = _checksum(data, at, size, side)
            right, wrong = right + good, wrong + (not good)
        start += side
        kind = data[start : start + 4]
        if not frames and not table[0] and kind in (b"Xing", b"Info"):
            flags, k, values, toc = int.from_bytes(data[start + 4 : start + 8], "big"), start + 8, [0, 0], b""
            for bit in (0, 1):
                if flags >> bit & 1:
                    values[bit], k = int.from_bytes(data[k : k + 4], "big"), k + 4
            if flags & 4:
                toc = data[k : k + 100]
            table = (kind.decode(), *values, toc)
        elif not frames and not table[0] and data[at + 36 : at + 40] == b"VBRI" and size >= 62:  # at a fixed place
            total, count_, points, scale, width, _ = struct.unpack(">IIHHHH", data[at + 46 : at + 62])
            steps = [int.from_bytes(data[k : k + width], "big") * scale for k in range(at + 62, min(at + 62 + points * width, at + size - width + 1), max(1, width))]
            table = ("VBRI", count_, total, b"".join(struct.pack(">I", sum(steps[: k + 1]) & 0xFFFFFFFF) for k in range(len(steps))))
        else:
            if frames % SEEK == 0:
                seeks.append(at)
            parts.append(data[start : at + size])
            frames, samples = frames + 1, samples + count
            rates.add(kbit)
        at += size
    if at == mark < end:
        tags.append(("ID3v1", data[mark + 3 : mark + 33].rstrip(b"\x00 ").decode("latin-1")))
        at = end
    skipped += max(0, end - at)
    payload = b"".join(parts)
    return {
        "payload": payload if stated is None else payload[:stated], "frames": frames, "samples": samples, "rate": hertz, "micros": samples * 1_000_000 // hertz if hertz else 0,
        "skipped": skipped, "crc_right": right, "crc_wrong": wrong, "table": table[0], "table_frames": table[1], "table_bytes": table[2], "toc": table[3], "tags": tags, "seeks": seeks, "rates": sorted(rates),
    }


def padded(text: str | None) -> bytes:
    """UTF-8 of text and zero bytes up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def media_column(docs: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """docs with a binary column: the padded text as an MPEG audio stream. Null and empty texts give one block of zeros.

    Texts of any length are stored whole, equal texts as equal streams. A column named like `out` is replaced, others and
    repeated rows stay. An empty table stays empty.
    """
    ready(docs.sparkSession)

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([write_stream(padded(x)) for x in batch], dtype=object)

    return docs.withColumn(out, encode(F.col(text_col)))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, duration_us long, skipped long, crc_wrong long, seek_offsets array<long>, feature string"


def features(data: bytes | None) -> tuple:
    """The FEATURES of one stream."""
    data = data or b""
    x = read_stream(data)
    payload, m = x["payload"], hashlib.sha256(x["toc"] + str(x["seeks"]).encode()).hexdigest()[:16]
    feature = f"mpeg1-l3;hz={x['rate']};frames={x['frames']};samples={x['samples']};us={x['micros']};kbps={','.join(map(str, x['rates']))};table={x['table']}:{x['table_frames']}:{x['table_bytes']};crc={x['crc_right']}/{x['crc_wrong']};skipped={x['skipped']};seek={len(x['seeks'])}:{m}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), x["frames"], x["micros"], x["skipped"], x["crc_wrong"], x["seeks"], feature


def media_features(media: DataFrame, media_col: str = "media", out: str = "features") -> DataFrame:
    """media with a struct column of FEATURES read back from the stored bytes. Null bytes count as an empty stream, and
    bytes without frames have no payload. A column named like `out` is replaced, others and repeated rows stay."""
    ready(media.sparkSession)

    @F.pandas_udf(FEATURES)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FEATURES.split(", ")]
        for batch in batches:
            yield pd.DataFrame([features(x) for x in batch], columns=names)

    return media.withColumn(out, read(F.col(media_col)))
