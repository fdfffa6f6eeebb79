"""Ogg media columns: page checksums, lacing, logical streams and granule timestamps.

``ogg_store`` writes each text as 8-bit samples into an Ogg file of two multiplexed logical
streams; ``ogg_read`` verifies and reads any such files back. Only the key and the payload
column are read, so further columns, whatever their names, are ignored. A null or empty text is
64 zero samples; a text of any length is stored whole. A null media value gives null results; so do damaged media,
with what is wrong with them in ``problem``. Repeated rows and null keys are rows like others, and equal texts give
equal files: nothing in them depends on the key. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .util import mapped

RATE = 8000
PACKET = 4096
STREAMS = 2
PAYLOAD_UNIT = 64
NO_PACKET = 0xFFFFFFFFFFFFFFFF
CONTINUED, FIRST, LAST = 1, 2, 4

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of Ogg: polynomial 04c11db7, most significant bit first, no inversion.

    zlib has the same polynomial with bits the other way round, so bits are mirrored before and after.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(length: int) -> bytes:
    return b"\xff" * (length // 255) + bytes([length % 255])


def _page(flags: int, granule: int, serial: int, number: int, segments: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBQIIIB", b"OggS", 0, flags, granule, serial, number, 0, len(segments)) + segments
    check = page_checksum(head + body)
    return head[:22] + struct.pack("<I", check) + head[26:] + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream. packets: bytes and the granule position at their end.

    The first packet is the header and has a page of its own. Packets may run over several pages.
    """
    pages = [_page(FIRST, 0, serial, 0, lacing(len(packets[0][0])), packets[0][0])]
    segments, ends, parts = bytearray(), [], []
    for data, granule in packets[1:]:
        segments += lacing(len(data))
        ends.append((len(segments), granule))
        parts.append(data)
    body, at, seg, continued = b"".join(parts), 0, 0, False
    done = 0
    while seg < len(segments):
        take = bytes(segments[seg : seg + 255])
        size = sum(take)
        granule = NO_PACKET
        while done < len(ends) and ends[done][0] <= seg + len(take):
            granule = ends[done][1]
            done += 1
        flags = (CONTINUED if continued else 0) | (LAST if seg + 255 >= len(segments) else 0)
        pages.append(_page(flags, granule, serial, len(pages), take, body[at : at + size]))
        continued = take[-1] == 255
        at += size
        seg += len(take)
    return pages


def encode(payload: bytes) -> bytes:
    """Deal packets of the payload over the streams in turn and multiplex the streams' pages."""
    base = zlib.crc32(payload)
    cut = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    streams = []
    for s in range(STREAMS):
        header = struct.pack("<8sBBIQ", b"SLUICE8\0", s, STREAMS, RATE, len(payload))
        packets, granule = [(header, 0)], 0
        for data in cut[s::STREAMS]:
            granule += len(data)
            packets.append((data, granule))
        if len(packets) == 1:
            packets.append((b"", 0))
        streams.append(stream_pages((base + s * 0x9E3779B9) & 0xFFFFFFFF, packets))
    out = [pages[0] for pages in streams]
    for i in range(1, max(map(len, streams))):
        out += [pages[i] for pages in streams if i < len(pages)]
    return b"".join(out)


@dataclass
class Logical:
    """One demultiplexed logical stream: packets, their end granules (-1 where no page says), pages."""

    serial: int
    pages: int = 0
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    ended: bool = False
    _open: list[bytes] | None = None

    def add(self, flags: int, granule: int, number: int, segments: bytes, body: memoryview) -> None:
        if self.ended or number != self.pages:
            raise ValueError(f"stream {self.serial}: page {number} where {self.pages} was due")
        if bool(flags & FIRST) != (self.pages == 0):
            raise ValueError(f"stream {self.serial}: wrong first-page flag")
        if bool(flags & CONTINUED) != (self._open is not None):
            raise ValueError(f"stream {self.serial}: wrong continuation flag")
        self.pages += 1
        at, size, closed = 0, 0, 0
        for x in segments:
            size += x
            if x < 255:
                part = bytes(body[at : at + size])
                self.packets.append(b"".join([*self._open, part]) if self._open else part)
                self.granules.append(-1)
                self._open = None
                at, size, closed = at + size, 0, closed + 1
        if segments and segments[-1] == 255:
            self._open = [*(self._open or []), bytes(body[at : at + size])]
        if (granule == NO_PACKET) != (closed == 0):
            raise ValueError(f"stream {self.serial}: granule position without an ending packet, or none with one")
        if closed:
            self.granules[-1] = granule
        self.ended = bool(flags & LAST)

    def timestamps(self, rate: int, samples: list[int]) -> list[float]:
        """Seconds at each data packet's end: known at pages' last packets, counted back between them."""
        out, after = [0.0] * len(self.granules), None
        for i in range(len(self.granules) - 1, -1, -1):
            if self.granules[i] >= 0:
                if after is not None and after != self.granules[i]:
                    raise ValueError(f"stream {self.serial}: granule positions and samples differ")
                after = self.granules[i]
            if after is None:
                raise ValueError(f"stream {self.serial}: no granule position at the end")
            out[i] = after / rate
            after -= samples[i]
        return out


def demultiplex(media: bytes) -> dict[int, Logical]:
    """Logical streams by serial number, in order of appearance; every page's checksum is verified."""
    view, at, streams = memoryview(media), 0, {}
    while at < len(media):
        if media[at : at + 4] != b"OggS" or len(media) < at + 27:
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, check, n = struct.unpack_from("<4sBBQIIIB", media, at)
        segments = media[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(segments)
        if version or len(segments) < n or end > len(media):
            raise ValueError(f"damaged page at byte {at}")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != check:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        streams.setdefault(serial, Logical(serial)).add(flags, granule, number, segments, view[start:end])
        at = end
    for s in streams.values():
        if not s.ended or s._open is not None:
            raise ValueError(f"stream {s.serial} is cut off")
    return streams


def decode(media: bytes) -> tuple[bytes, str]:
    """The payload and a text of features: streams, pages, packets, duration, sample statistics."""
    dealt, pages, end, rate, size = {}, 0, 0.0, RATE, 0
    streams = demultiplex(media)
    for s in streams.values():
        name, k, n, rate, size = struct.unpack("<8sBBIQ", s.packets[0])
        if name != b"SLUICE8\0" or n != len(streams) or k in dealt:
            raise ValueError("not a sample stream of this writer")
        times = s.timestamps(rate, [0, *(len(p) for p in s.packets[1:])])
        end += times[-1]
        pages += s.pages
        dealt[k] = [p for p in s.packets[1:] if p]
    n = len(dealt)
    packets = sum(map(len, dealt.values()))
    payload = b"".join(dealt[i % n][i // n] for i in range(packets))
    if len(payload) != size:
        raise ValueError("samples are missing")
    x = np.frombuffer(payload, dtype=np.uint8)
    mean = int(x.sum(dtype=np.int64)) / max(1, len(x))
    peak = int(x.max()) if len(x) else 0
    turns = int(np.count_nonzero(np.diff((x > 127).view(np.int8))))
    return payload, f"streams={n};pages={pages};packets={packets};seconds={end:.6f};mean={mean:.6f};peak={peak};crossings={turns}"


def padded(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % PAYLOAD_UNIT or (0 if data else PAYLOAD_UNIT))


def ogg_store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the whole text of each row, padded, as an Ogg file."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            media = pa.array([encode(padded(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), media], [key, "n_bytes", "media"])

    return mapped(df.select(key, text), run, f"`{key}` {kind}, n_bytes long, media binary")


def ogg_read(df: DataFrame, key: str = "doc_id", media: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, payload figures, media figures, feature, problem) of each Ogg file."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *carry))
    names = [key, *carry, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "problem"]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        whole = len(data), hashlib.sha256(data).hexdigest()
        try:
            payload, feature = decode(data)
        except (ValueError, struct.error, IndexError) as e:
            return None, None, None, *whole, None, str(e)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAYLOAD_UNIT:]), *whole, feature, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            rows = [one(x.as_py()) for x in b.column(b.num_columns - 1)]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names)

    out = fields + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, problem string"
    return mapped(df.select(key, *carry, media), run, out)
