"""Ogg as a media column: pages with checksums, lacing, multiplexed logical streams, granule times.

The codec below is the container of RFC 3533. A page is a 27-byte header, a
table of lacing values and the segments they measure; a packet is a run of
segments that ends with the first lacing value under 255. The page checksum is
the CRC with polynomial 0x04c11db7, most significant bit first, zero start: the
same polynomial as zlib's, mirrored, so it is computed by zlib over
bit-reversed bytes.

Edge cases: a null text counts as empty; an empty text is stored as one block
of zero bytes; a page whose checksum fails is dropped, counted, and takes with
it the packet that was open on its stream; bytes between pages are skipped; a very
long text continues over as many pages as it needs; a null id stays null;
repeated rows give equal values; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsift.llm.common import chunks, whole_text

CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = 0xFFFFFFFFFFFFFFFF
HEADER = struct.Struct("<4sBBQIIIB")
REVERSED_BITS = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))

BLOCK = 64
RATE = 8000
PACKET_BYTES = 4096
PACKETS_A_PAGE = 8
SAMPLE_MAGIC, INDEX_MAGIC = b"U8PCM\x00", b"U8IDX\x00"


def checksum(page: bytes) -> int:
    """The page's CRC; its own four checksum bytes must be zero."""
    mirrored = zlib.crc32(page.translate(REVERSED_BITS), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(REVERSED_BITS), "big")


def page_bytes(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule & NO_GRANULE, serial, sequence, 0, len(lacing))
    page = head + lacing + body
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def paginate(serial: int, packets: Iterable[tuple[bytes, int]], packets_a_page: int = PACKETS_A_PAGE) -> list[bytes]:
    """Pages of one logical stream. packets: (bytes, granule at its end).

    The first packet has a page of its own, as beginning-of-stream pages must.
    A page holds at most 255 segments, so long packets continue on further pages.
    """
    pages: list[list] = []
    lacing, body, ended, granule, carried, alone = bytearray(), bytearray(), 0, NO_GRANULE, False, True

    def flush(continues: bool) -> None:
        nonlocal lacing, body, ended, granule, carried
        pages.append([CONTINUED if carried else 0, granule, bytes(lacing), bytes(body)])
        lacing, body, ended, granule, carried = bytearray(), bytearray(), 0, NO_GRANULE, continues

    for data, at in packets:
        values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        done = 0
        while done < len(values):
            if len(lacing) == 255:
                flush(done > 0)
            take = values[done : done + 255 - len(lacing)]
            lacing += take
            body += data[done * 255 : (done + len(take)) * 255]
            done += len(take)
        ended, granule = ended + 1, at
        if alone or ended >= packets_a_page:
            flush(False)
            alone = False
    if lacing or not pages:
        flush(False)
    pages[0][0] |= FIRST
    pages[-1][0] |= LAST
    return [page_bytes(serial, i, *x) for i, x in enumerate(pages)]


def multiplex(streams: list[list[bytes]]) -> bytes:
    """Physical stream: all first pages, then the others in turn."""
    out = [s[0] for s in streams]
    for i in range(1, max(map(len, streams))):
        out += [s[i] for s in streams if i < len(s)]
    return b"".join(out)


@dataclass
class LogicalStream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position of the page on which each packet ended; None where it isn't the last to end there.
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    _open: bytearray | None = None
    _next: int | None = None


@dataclass
class Physical:
    streams: dict[int, LogicalStream] = field(default_factory=dict)
    bad_pages: int = 0
    skipped_bytes: int = 0


def demultiplex(data: bytes) -> Physical:
    """Verifies every page and reassembles the packets of each logical stream."""
    out, at, n = Physical(), 0, len(data)
    while at < n:
        if data[at : at + 4] != CAPTURE or at + 27 > n:
            after = data.find(CAPTURE, at + 1)
            after = n if after < 0 else after
            out.skipped_bytes += after - at
            at = after
            continue
        _, version, flags, granule, serial, sequence, crc, n_segments = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n_segments]
        end = at + 27 + n_segments + sum(lacing)
        page = data[at:end]
        if version or end > n or len(lacing) < n_segments or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            out.bad_pages += 1
            out.skipped_bytes += 1
            at += 1
            continue
        s = out.streams.setdefault(serial, LogicalStream(serial))
        if s._next is not None and sequence != s._next:
            s.gaps += 1
            s._open = None
        s._next = sequence + 1
        s.pages += 1
        s.ended = s.ended or bool(flags & LAST)
        if flags & CONTINUED:
            skipping = s._open is None
            part = s._open if s._open is not None else bytearray()
        else:
            skipping, part = False, bytearray()
        body, last = at + 27 + n_segments, None
        for value in lacing:
            part += data[body : body + value]
            body += value
            if value < 255:
                if not skipping:
                    s.packets.append(bytes(part))
                    s.granules.append(None)
                    last = len(s.packets) - 1
                part, skipping = bytearray(), False
        s._open = part if n_segments and lacing[-1] == 255 and not skipping else None
        if last is not None and granule != NO_GRANULE:
            s.granules[last] = granule
        at = end
    return out


def timestamps(stream: LogicalStream, rate: int) -> list[float | None]:
    """Seconds at each packet's end, from granule positions at ``rate`` a second."""
    return [None if g is None else g / rate for g in stream.granules]


def encode_payload(text: bytes) -> bytes:
    """The bytes padded to a positive multiple of 64, as 8-bit samples in one logical stream and
    their unpadded length in a second one."""
    payload = text + bytes((-len(text)) % BLOCK if text else BLOCK)
    serial = zlib.crc32(payload)
    parts = [(payload[i : i + PACKET_BYTES], min(i + PACKET_BYTES, len(payload))) for i in range(0, len(payload), PACKET_BYTES)]
    samples = paginate(serial, [(SAMPLE_MAGIC + struct.pack("<IQ", RATE, len(payload)), 0), *parts])
    index = paginate(serial ^ 0x5A5A5A5A, [(INDEX_MAGIC, 0), (struct.pack("<Q", len(text)), len(payload))])
    return multiplex([samples, index])


def decode_payload(media: bytes) -> dict:
    """Payload, unpadded length and stream facts read back from the stored bytes."""
    physical = demultiplex(media)
    samples = next(s for s in physical.streams.values() if s.packets and s.packets[0].startswith(SAMPLE_MAGIC))
    index = next(s for s in physical.streams.values() if s.packets and s.packets[0].startswith(INDEX_MAGIC))
    rate, declared = struct.unpack("<IQ", samples.packets[0][len(SAMPLE_MAGIC) :])
    payload = b"".join(samples.packets[1:])
    if len(payload) != declared or physical.bad_pages or samples.gaps:
        raise ValueError("the stored stream is damaged")
    seconds = [t for t in timestamps(samples, rate) if t is not None][-1]
    return {
        "payload": payload, "n_bytes": struct.unpack("<Q", index.packets[1])[0], "seconds": seconds,
        "streams": len(physical.streams), "pages": sum(s.pages for s in physical.streams.values()),
        "packets": sum(len(s.packets) for s in physical.streams.values()),
    }


def features(decoded: dict) -> str:
    """Stream shape and signal statistics of the samples (unsigned, centred on 128)."""
    x = np.frombuffer(decoded["payload"], np.uint8).astype(np.int64) - 128
    total, square = int(x.sum()), int((x * x).sum())
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return (
        f"streams={decoded['streams']};pages={decoded['pages']};packets={decoded['packets']};"
        f"ms={round(decoded['seconds'] * 1000)};mean={total / len(x):.4f};rms={(square / len(x)) ** 0.5:.4f};"
        f"peak={int(np.abs(x).max())};crossings={crossings}"
    )


def store_texts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "media") -> DataFrame:
    """``keep`` columns and the text's Ogg stream as a binary column."""
    kept = df.select(*keep, whole_text(text).alias("_text"))
    schema = kept.select(*keep, F.lit(b"").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text"):
            texts = b.column("_text").cast(pa.binary())
            media = pa.array([encode_payload(x) for x in texts.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], media], [*keep, out])

    return kept.mapInArrow(run, schema)


FEATURE_FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Decodes the stored streams: sizes, digests and features, one row for each stream."""
    kept = df.select(*keep, media)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", " + FEATURE_FIELDS
    names = [*keep, *(x.split()[0] for x in FEATURE_FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, media):
            rows = []
            for stored in b.column(media).to_pylist():
                d = decode_payload(stored)
                p = d["payload"]
                rows.append((d["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(d)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *columns], names)

    return kept.mapInArrow(run, schema)
