"""Ogg files in binary columns: pages, packets, logical streams and their times."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, sliced, tidy

#: Fixed values of the Ogg page format.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")  # pattern, version, flags, granule, serial, page number, checksum, lacing values
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
MOST_LACES = 255

#: The identification packet of this module's streams: magic, sample rate, channels, bits.
MAGIC = b"PCM8"
IDENT = struct.Struct("<4sIBB")

#: Bits of each byte in reverse: the page checksum runs from the highest bit down.
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """The page checksum: CRC-32 without reflection, first value and last mask 0."""
    raw = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, laces: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number & 0xFFFFFFFF, 0, len(laces)) + laces
    whole = bytearray(head + body)
    struct.pack_into("<I", whole, 22, checksum(bytes(whole)))
    return bytes(whole)


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream of (packet, granule at its end)."""
    pages: list[bytes] = []
    laces, body, granule, begins_inside = bytearray(), [], NO_GRANULE, False

    def flush(last: bool = False) -> None:
        nonlocal laces, body, granule, begins_inside
        flags = CONTINUED * begins_inside | FIRST * (not pages) | LAST * last
        pages.append(_page(flags, granule, serial, len(pages), bytes(laces), b"".join(body)))
        begins_inside = bool(laces) and laces[-1] == 255
        laces, body, granule = bytearray(), [], NO_GRANULE

    for k, (packet, end) in enumerate(packets):
        left = len(packet) // 255 + 1  # the last lacing value is below 255, so that a packet ends
        at = 0
        while left:
            take = min(left, MOST_LACES - len(laces))
            done = take == left
            laces += b"\xff" * (take - done) + (bytes([len(packet) % 255]) if done else b"")
            size = (take - done) * 255 + (len(packet) % 255 if done else 0)
            body.append(packet[at : at + size])
            at += size
            left -= take
            if done:
                granule = end
            if len(laces) == MOST_LACES and (left or k < len(packets) - 1):
                flush()
        if not pages:
            flush()  # the first packet has the first page to itself
    flush(last=True)
    return pages


@dataclass
class Stream:
    """What was read of one logical stream."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # at the packet's end; -1 where its page doesn't say
    pages: int = 0
    ended: bool = False
    lost: int = 0  # pages missing or packets without their begin or end
    _part: list[bytes] | None = None
    _next: int = 0

    def add(self, flags: int, granule: int, number: int, laces: bytes, body: bytes) -> None:
        if number != self._next:
            self.lost += 1
            self._part = None
        self._next = number + 1
        self.pages += 1
        self.ended |= bool(flags & LAST)
        skip = bool(flags & CONTINUED) and self._part is None  # the rest of a packet whose begin is lost
        if not flags & CONTINUED and self._part is not None:
            self.lost += 1
            self._part = None
        at, ended_here = 0, []
        for lace in laces:
            if self._part is None:
                self._part = []
            self._part.append(body[at : at + lace])
            at += lace
            if lace < 255:
                if skip:
                    self.lost += 1
                    skip = False
                else:
                    ended_here.append(len(self.packets))
                    self.packets.append(b"".join(self._part))
                    self.granules.append(NO_GRANULE)
                self._part = None
        if ended_here:
            self.granules[ended_here[-1]] = granule

    def times(self, rate: int) -> list[float | None]:
        """Seconds at the end of each packet, where its page gives a granule position."""
        return [g / rate if g >= 0 and rate else None for g in self.granules]


def read_streams(data: bytes) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial number, and how many pages failed their checksum.

    A page that fails, or bytes that are no page, are skipped up to the next capture
    pattern; what they held counts as lost in its stream.
    """
    streams: dict[int, Stream] = {}
    bad = at = 0
    while (at := data.find(CAPTURE, at)) >= 0:
        if at + HEADER.size > len(data):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        body_at = at + HEADER.size + n
        laces = data[at + HEADER.size : body_at]
        end = body_at + sum(laces)
        page = data[at:end]
        if version or len(laces) < n or end > len(data) or checksum(page[:22] + bytes(4) + page[26:]) != crc:
            bad += 1
            at += 4
            continue
        streams.setdefault(serial, Stream(serial)).add(flags, granule, number, laces, data[body_at:end])
        at = end
    return streams, bad


def store(payload: bytes, rate: int = 8000, packet: int = 4000, serial: int = 1) -> bytes:
    """An Ogg file of 8-bit mono samples, with a second stream that says how many there are.

    The two logical streams' pages lie alternately. Each sample packet's granule
    position is the number of samples up to its end.
    """
    samples = [(IDENT.pack(MAGIC, rate, 1, 8), 0)]
    samples += [(payload[a : a + packet], min(a + packet, len(payload))) for a in range(0, len(payload), packet)]
    about = [(b"PCM8-ABOUT", 0), (struct.pack("<Q", len(payload)), len(payload))]
    one, two = stream_pages(serial, samples), stream_pages(serial + 1, about)
    mixed = [p for pair in zip(one, two, strict=False) for p in pair]
    short = min(len(one), len(two))
    return b"".join(mixed + one[short:] + two[short:])


@dataclass
class Media:
    payload: bytes
    rate: int
    seconds: float
    packets: int
    pages: int
    bad_pages: int
    lost: int


def load(data: bytes) -> Media:
    """Samples and times of the stream of samples in an Ogg file."""
    streams, bad = read_streams(data)
    for s in streams.values():
        if s.packets and s.packets[0].startswith(MAGIC) and len(s.packets[0]) == IDENT.size:
            rate = IDENT.unpack(s.packets[0])[1]
            known = [t for t in s.times(rate) if t is not None]
            return Media(
                b"".join(s.packets[1:]), rate, max(known, default=0.0), len(s.packets) - 1,
                sum(x.pages for x in streams.values()), bad, sum(x.lost for x in streams.values()),
            )
    return Media(b"", 0, 0.0, 0, sum(x.pages for x in streams.values()), bad, sum(x.lost for x in streams.values()))


def feature(media: Media, bins: int = 16) -> str:
    """Shares of sample values in ``bins`` ranges, mean, deviation, share of sign changes
    about the middle, and seconds."""
    x = np.frombuffer(media.payload, np.uint8)
    if not len(x):
        return ""
    shares = np.bincount(x >> 4, minlength=bins)[:bins] / len(x)
    wave = x.astype(np.int16) - 128
    turns = np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)) / max(len(x) - 1, 1)
    return ",".join(f"{v:.6f}" for v in [*shares, wave.mean(), wave.std(), turns, media.seconds])


MEDIA = T.StructType(
    [
        T.StructField("rate", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("packets", T.LongType()),
        T.StructField("pages", T.LongType()),
        T.StructField("bad_pages", T.LongType()),
        T.StructField("lost", T.LongType()),
        T.StructField("feature", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def read_media(files: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """One row a file: the id and what its stream of samples holds.

    Null and files without such a stream give rate 0 and an empty payload; damaged pages
    are counted, never an error.
    """
    schema = T.StructType([files.schema[id_col], *MEDIA.fields])

    @tidy
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(batch.num_rows):
                m = load(batch.column(1)[at].as_py() or b"")
                row = [m.rate, m.seconds, m.packets, m.pages, m.bad_pages, m.lost, feature(m), m.payload]
                kinds = [pa.int32(), pa.float64(), *[pa.int64()] * 4, pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 1), *(pa.array([v], k) for v, k in zip(row, kinds, strict=True))],
                    schema.names,
                )

    return files.select(id_col, media_col).mapInArrow(run, schema)


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_bytes`` and ``media``: each text's bytes, padded with zeros to a
    positive multiple of 64, as the samples of an Ogg file. Null counts as empty."""
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    )

    @tidy
    def run(batches: Batches) -> Batches:
        for batch in sliced(batches):
            ids, texts = batch.columns
            raw = [(t or "").encode() for t in texts.to_pylist()]
            media = [store(padded(r)) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], schema.names
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as Ogg, read the stored bytes back, and describe both.

    Returns the id, ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32``
    (of the last 64 bytes), ``media_bytes``, ``media_sha256`` and ``feature``. The
    payload is what reading the file gives. Equal texts have equal results; null counts
    as empty; other columns are not read. Repeated rows give as many rows, an empty table none. A
    text is stored and read back whole, in pages of at most 65,025 bytes, and takes some times
    its size of a worker's memory.
    """
    stored = write_media(docs, id_col, text_col)
    schema = T.StructType(
        [docs.schema[id_col]]
        + [
            T.StructField(name, T.StringType() if name in ("payload_sha256", "media_sha256", "feature") else T.LongType())
            for name in (
                "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
            )
        ]
    )

    @tidy
    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, sizes, files = batch.columns
            rows = []
            for k in range(batch.num_rows):
                data = files[k].as_py()
                m = load(data)
                rows.append(
                    (
                        len(m.payload), hashlib.sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-64:]),
                        len(data), hashlib.sha256(data).hexdigest(), feature(m),
                    )
                )
            kinds = [schema[n].dataType for n in schema.names[2:]]
            columns = [
                pa.array(c, pa.string() if isinstance(k, T.StringType) else pa.int64())
                for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([ids, sizes, *columns], schema.names)

    return stored.select(F.col(id_col), "n_bytes", "media").mapInArrow(run, schema)
