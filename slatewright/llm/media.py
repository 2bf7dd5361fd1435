"""Operator 2: media columns as Ogg.

Writing: a text's bytes, padded to whole frames, become packets of one frame each, dealt
in turn to two logical streams; packets become lacing values, pages with checksums,
serial numbers, sequence numbers and granule positions.  Reading: every page's checksum
is verified, packets are reassembled from lacing values (also across pages), logical
streams are demultiplexed, and each packet's time follows from the granule positions;
the payload is the packets in order of time.

Null and empty texts are one frame of padding.  Equal texts give equal bytes.  Repeated
rows give equal rows; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, need, utf8

FRAME = 576
RATE = 48_000
STREAMS = 2
#: Lacing values in a page (255 at most by the format); no multiple of a packet's three,
#: so that packets go on from page to page.
SEGMENTS = 250
HEAD = b"\x01pcmtxt8"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1

_HEADER = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """A stream that breaks the format."""


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, no inversions.
    zlib's runs least significant bit first, so bits are reversed going in and out."""
    return int(f"{~zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) & 0xFFFFFFFF:032b}"[::-1], 2)


def lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def pages(packets: list[bytes], granules: list[int], serial: int, segments: int = SEGMENTS) -> list[tuple[int, bytes]]:
    """(granule position, page) of one logical stream.  A page's granule position is that
    of the last packet that ends on it, NO_GRANULE if none does.  The first packet, the
    header, has a page to itself."""
    out: list[tuple[int, bytes]] = []

    def emit(values: bytes, body: bytes, granule: int, flags: int) -> None:
        page = _HEADER.pack(b"OggS", 0, flags, granule, serial, len(out), 0, len(values)) + values + body
        out.append((granule, page[:22] + struct.pack("<I", checksum(page)) + page[26:]))

    emit(lacing(len(packets[0])), packets[0], granules[0], FIRST | (LAST if len(packets) == 1 else 0))
    values = b"".join(lacing(len(p)) for p in packets[1:])
    body = b"".join(packets[1:])
    ends = [i + 1 for i, v in enumerate(values) if v < 255]
    done = at = 0
    for start in range(0, len(values), segments):
        part = values[start : start + segments]
        before = done
        while done < len(ends) and ends[done] <= start + len(part):
            done += 1
        size = sum(part)
        flags = (CONTINUED if start and values[start - 1] == 255 else 0) | (LAST if start + segments >= len(values) else 0)
        emit(part, body[at : at + size], granules[done] if done > before else NO_GRANULE, flags)
        at += size
    return out


def write(payload: bytes, frame: int = FRAME, streams: int = STREAMS, rate: int = RATE) -> bytes:
    """An Ogg file of 8-bit samples: frame k is packet k // streams of stream k % streams
    and ends at sample (k + 1) * frame."""
    if not payload or len(payload) % frame:
        raise ValueError("the payload is not whole frames")
    base = zlib.crc32(payload)
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    made = []
    for s in range(streams):
        own = frames[s::streams]
        head = HEAD + struct.pack("<BBII", s, streams, rate, frame)
        granules = [0] + [(s + k * streams + 1) * frame for k in range(len(own))]
        made.append(pages([head, *own], granules, (base + s) & 0xFFFFFFFF))
    out = [p[0][1] for p in made]  # header pages of all streams come first
    rest = sorted(((max(g, 0), s, k, page) for s, p in enumerate(made) for k, (g, page) in enumerate(p[1:])), key=lambda x: (x[2], x[1]))
    return b"".join(out + [x[3] for x in rest])


def read_pages(data: bytes):
    """(flags, granule, serial, sequence, lacing values, body) of each verified page."""
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError(f"truncated page header at byte {at}")
        magic, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        values = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(values)
        if len(values) < n or end > len(data):
            raise OggError(f"truncated page at byte {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        yield flags, granule, serial, number, values, data[at + 27 + n : end]
        at = end


def demultiplex(data: bytes) -> dict[int, list[tuple[int | None, bytes]]]:
    """Packets of each logical stream by serial number, each with its granule position if
    it is the last that ends on its page, else None."""
    streams: dict[int, list] = {}
    partial: dict[int, bytes | None] = {}
    counts: dict[int, int] = {}
    ended: set[int] = set()
    for flags, granule, serial, number, values, body in read_pages(data):
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial], partial[serial], counts[serial] = [], None, 0
        if serial not in streams or serial in ended:
            raise OggError(f"a page of stream {serial} outside the stream")
        if number != counts[serial]:
            raise OggError(f"page {counts[serial]} of stream {serial} is missing")
        counts[serial] += 1
        if bool(flags & CONTINUED) != (partial[serial] is not None):
            raise OggError(f"broken continuation in stream {serial}")
        kept, at, first, last = partial[serial] or b"", 0, 0, None
        pending = partial[serial] is not None
        for i, v in enumerate(values):
            at += v
            pending = True
            if v < 255:
                streams[serial].append([None, kept + body[first:at]])
                kept, first, last, pending = b"", at, len(streams[serial]) - 1, False
        partial[serial] = kept + body[first:] if pending else None
        if last is not None:
            streams[serial][last][0] = granule
        elif granule != NO_GRANULE:
            raise OggError(f"granule position without a packet's end in stream {serial}")
        if flags & LAST:
            ended.add(serial)
            if partial[serial] is not None:
                raise OggError(f"stream {serial} ends inside a packet")
    if ended != set(streams):
        raise OggError("a stream has no end")
    return {k: [(g, p) for g, p in v] for k, v in streams.items()}


def read(data: bytes) -> tuple[bytes, dict[str, object]]:
    """Payload and features of a file that write() made."""
    timed: list[tuple[int, bytes]] = []
    n_packets = 0
    streams = demultiplex(data)
    rate = 0
    for serial, packets in streams.items():
        head = packets[0][1]
        if head[: len(HEAD)] != HEAD:
            raise OggError(f"unknown codec in stream {serial}")
        _, n_streams, rate, frame = struct.unpack("<BBII", head[len(HEAD) :])
        own = packets[1:]
        n_packets += len(own)
        # Only the last packet of a page has a position; those before it on the page count
        # back from it by the frames that the other streams' packets take in between.
        ends: list[int] = [0] * len(own)
        known = None
        for i in range(len(own) - 1, -1, -1):
            known = own[i][0] if own[i][0] is not None else (known - n_streams * frame if known is not None else None)
            if known is None:
                raise OggError(f"no granule position at the end of stream {serial}")
            ends[i] = known
        timed += [(e, p) for e, (_, p) in zip(ends, own, strict=True)]
    timed.sort(key=lambda x: x[0])
    payload = b"".join(p for _, p in timed)
    expected = 0
    for end, p in timed:
        expected += len(p)
        if end != expected:
            raise OggError("granule positions leave a gap")
    return payload, {"pages": sum(1 for _ in read_pages(data)), "streams": len(streams), "packets": n_packets, "duration": expected / rate}


def features(data: bytes, payload: bytes, facts: dict[str, object]) -> str:
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    total = int((counts * np.arange(256)).sum())
    square = int((counts * np.arange(256) ** 2).sum())
    n = len(samples)
    crossings = int(np.count_nonzero(np.diff(samples > 127)))
    return f"streams={facts['streams']};packets={facts['packets']};pages={facts['pages']};seconds={facts['duration']:.6f};mean={total / n:.6f};rms={(square / n) ** 0.5:.6f};crossings={crossings};peak={int(samples.max())}"


def store(text: bytes) -> tuple[bytes, bytes]:
    """The payload of a text and its media file."""
    payload = text + b"\xff" * ((-len(text)) % FRAME or (0 if text else FRAME))
    return payload, write(payload)


def media(df: DataFrame, *, keep_bytes: bool = False) -> DataFrame:
    """One row per document: the features of its file as read back, and with
    ``keep_bytes`` the file itself in column media."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, files = [], []
        for text in utf8(batch.column(1)):
            _, data = store(text)
            payload, facts = read(data)
            rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(data, payload, facts)))
            files.append(data if keep_bytes else None)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = [batch.column(0)] + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(cols + [pa.array(files, pa.binary())] * keep_bytes, names=names + ["media"] * keep_bytes)

    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_bytes
    return arrow_map(need(df, "doc_id", "text"), work, schema)
