"""Ogg container: write a payload as a logical stream of 8-bit samples and read it back.

Reading verifies each page's checksum, reassembles packets from lacing values (also across pages),
demultiplexes logical streams by serial number and derives times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sparktrace.llm.common import named, numbered

FRAME = 576
RATE = 8000
#: Serial numbers of the two logical streams: samples, and the description of the text.
SAMPLES, ABOUT = 0x53, 0x41
HEAD = struct.Struct("<4sBBqIIIB")
PAGE_FRAMES = 85  # 576 = 255 + 255 + 66: three lacing values a frame, 255 a page
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg CRC-32 (polynomial 04c11db7, not reflected, zero start), by way of the reflected one on mirrored bits."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def page(serial: int, number: int, granule: int, table: bytes, body: bytes, flags: int = 0) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(table)) + table
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def store(payload: bytes, n_bytes: int) -> bytes:
    """Two multiplexed streams: first pages of both, then the samples in frames, then the end of the other."""
    about = struct.pack("<4sIQ", b"text", RATE, n_bytes)
    out = [page(SAMPLES, 0, 0, lacing(8), struct.pack("<4sI", b"pcm8", RATE), 2), page(ABOUT, 0, 0, lacing(len(about)), about, 2)]
    step = PAGE_FRAMES * FRAME
    for number, at in enumerate(range(0, len(payload), step), 1):
        body = payload[at : at + step]
        out.append(page(SAMPLES, number, at + len(body), lacing(FRAME) * (len(body) // FRAME), body, 4 * (at + step >= len(payload))))
    out.append(page(ABOUT, 1, n_bytes, lacing(0), b"", 4))
    return b"".join(out)


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(serial, number, flags, granule, lacing values, body) of each page; a bad checksum or length is an error."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            raise ValueError(f"no page at byte {at}")
        _, _, flags, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        table = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(table)
        if end > len(data) or len(table) < n:
            raise ValueError(f"page at byte {at} is cut off")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"page at byte {at} fails its checksum")
        yield serial, number, flags, granule, table, view[at + 27 + n : end]
        at = end


def demultiplex(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets of each logical stream with the granule position of the page each ends on (-1: none given)."""
    done: dict[int, list[tuple[bytes, int]]] = {}
    part: dict[int, list[bytes]] = {}
    expect: dict[int, int] = {}
    for serial, number, flags, granule, table, body in pages(data):
        if number != expect.get(serial, 0):
            raise ValueError(f"stream {serial}: page {expect.get(serial, 0)} is missing")
        expect[serial] = number + 1
        packets, open_ = done.setdefault(serial, []), part.setdefault(serial, [])
        if bool(flags & 1) != bool(open_):
            raise ValueError(f"stream {serial}: page {number} doesn't continue the one before")
        at = size = 0
        for value in table:
            size += value
            if value < 255:
                open_.append(bytes(body[at : at + size]))
                packets.append((b"".join(open_), granule))
                at, size = at + size, 0
                open_.clear()
        if size or (table and table[-1] == 255):
            open_.append(bytes(body[at : at + size]))
    if any(part.values()):
        raise ValueError("a stream ends inside a packet")
    return done


def load(data: bytes) -> tuple[bytes, int, float]:
    """Payload, unpadded size and duration in seconds (last granule position over the rate)."""
    streams = demultiplex(data)
    frames = streams[SAMPLES][1:]
    _, rate, n_bytes = struct.unpack("<4sIQ", streams[ABOUT][0][0])
    payload = b"".join(p for p, _ in frames)
    if frames and frames[-1][1] != len(payload):
        raise ValueError("granule position and samples differ")
    return payload, n_bytes, (frames[-1][1] if frames else 0) / rate


def pad(text: bytes) -> bytes:
    size = max(FRAME, -(-len(text) // FRAME) * FRAME)
    return text.ljust(size, b"\xff")


def feature(payload: bytes, seconds: float) -> str:
    """Duration, level, and spread of the samples read back, about their middle value."""
    x = np.frombuffer(payload, np.uint8)
    hist = np.bincount(x, minlength=256)
    values = np.arange(256) - 128
    mean, power = hist @ values / len(x), hist @ (values * values) / len(x)
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"{seconds:.4f}s mean={mean:.4f} rms={power**0.5:.4f} crossings={turns} distinct={np.count_nonzero(hist)}"


def media_row(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    stored = store(pad(raw), len(raw))
    payload, n_bytes, seconds = load(stored)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return n_bytes, len(payload), sha(payload), zlib.crc32(payload[-32:]), len(stored), sha(stored), feature(payload, seconds), stored


COLUMNS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
SCHEMA = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """One row per document with its stored form in column media (left out on request) and what was read back.

    A null text counts as empty, an empty one is a frame of padding; a null doc_id stays null;
    repeated rows give repeated results; further columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([media_row(t)[: None if keep_media else -1] for t in batch["text"]], columns=COLUMNS[: None if keep_media else -1])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return numbered(named(docs, "text").mapInPandas(run, SCHEMA + ", media binary" * keep_media))
