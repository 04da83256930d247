"""Media columns in Ogg: a container writer, and a reader that checks all it reads.

`packed` stores bytes losslessly as 8-bit samples in two logical streams (packets alternate
between them); `unpacked` walks the pages, verifies each page's checksum, sequence number
and flags, demultiplexes the logical streams by serial number, reassembles packets from the
lacing values (over page borders too), and derives each page's time from its granule
position.  Operator: `media_columns`.

Cases: a null or empty text becomes one packet of spaces; texts of any length are stored
whole; damaged pages raise CorruptPage with the reason; rows with null or repeated doc_ids
are rows like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectra.llm.common import documents, ids, in_batches

UNIT = 192
RATE = 8000
#: Bytes of a data packet; a packet of sample data goes to stream 0 and 1 in turn.
PACKET = 6144
#: Most lacing values in a page.
SEGMENTS = 255
#: Fixed values of the container: capture pattern, header flags, checksum polynomial 0x04C11DB7.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
MAGIC = b"PCM8\0\0\0\1"
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages long, packets long, seconds double, media binary"


class CorruptPage(ValueError):
    """A page that the reader can't trust."""


def checksum(page: bytes) -> int:
    """The container's CRC: zlib's with every byte and the result mirrored, starting from 0."""
    mirrored = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(REVERSED), "big")


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream; packets: (bytes, granule position at its end)."""
    pages: list[bytes] = []
    lacing, body, granule, continued = bytearray(), [], -1, False

    def close(last: bool = False) -> None:
        nonlocal lacing, body, granule, continued
        flags = CONTINUED * continued | FIRST * (not pages) | LAST * last
        head = HEAD.pack(CAPTURE, 0, flags, granule, serial, len(pages), 0, len(lacing))
        page = bytearray(head + lacing + b"".join(body))
        page[22:26] = checksum(bytes(page)).to_bytes(4, "little")
        pages.append(bytes(page))
        continued = bool(lacing) and lacing[-1] == 255
        lacing, body, granule = bytearray(), [], -1

    for n, (data, end) in enumerate(packets):
        values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        at = 0
        while values:
            if len(lacing) == SEGMENTS:
                close()
            fit = values[: SEGMENTS - len(lacing)]
            values = values[len(fit) :]
            size = sum(fit)
            body.append(data[at : at + size])
            lacing += fit
            at += size
        granule = end
        if n == 0:
            close()  # a stream's header packet has a page of its own
    close(last=True)
    return pages


def packed(payload: bytes, rate: int = RATE) -> bytes:
    """payload as an Ogg file of two logical streams with 8-bit samples."""
    streams: list[list[tuple[bytes, int]]] = []
    for k in range(2):
        own = [payload[i : i + PACKET] for i in range(k * PACKET, len(payload), 2 * PACKET)]
        ends = np.cumsum([len(x) for x in own], dtype=np.int64).tolist()
        head = MAGIC + struct.pack("<IIQ", rate, k, len(payload))
        streams.append([(head, 0), *zip(own, ends)])
    written = [_pages(k + 1, s) for k, s in enumerate(streams)]
    out = [pages[0] for pages in written]  # all first pages come before any other
    for i in range(1, max(map(len, written))):
        out += [pages[i] for pages in written if i < len(pages)]
    return b"".join(out)


def unpacked(media: bytes) -> tuple[bytes, dict]:
    """(payload, facts) of an Ogg file; facts: pages, packets, seconds, and times per page."""
    at, pages = 0, 0
    parts: dict[int, bytearray] = {}
    packets: dict[int, list[bytes]] = {}
    sequence: dict[int, int] = {}
    ended: set[int] = set()
    granules: list[tuple[int, int]] = []
    while at < len(media):
        if len(media) < at + HEAD.size:
            raise CorruptPage("page header cut short")
        capture, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise CorruptPage(f"no page at byte {at}")
        begin = at + HEAD.size + n
        lacing = media[at + HEAD.size : begin]
        end = begin + sum(lacing)
        if end > len(media) or len(lacing) < n:
            raise CorruptPage("page body cut short")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise CorruptPage(f"wrong checksum at byte {at}")
        if bool(flags & FIRST) != (serial not in packets) or serial in ended:
            raise CorruptPage("page outside its stream")
        if number != sequence.get(serial, 0):
            raise CorruptPage("page lost or out of order")
        own, part = packets.setdefault(serial, []), parts.setdefault(serial, bytearray())
        if bool(flags & CONTINUED) != bool(part):
            raise CorruptPage("packet broken off between pages")
        sequence[serial] = number + 1
        # a value below 255 ends a packet
        where = begin
        for value in lacing:
            part += media[where : where + value]
            where += value
            if value < 255:
                own.append(bytes(part))
                part.clear()
        if flags & LAST:
            ended.add(serial)
        if granule >= 0:
            granules.append((serial, granule))
        at, pages = end, pages + 1
    if set(packets) != ended or any(parts.values()):
        raise CorruptPage("stream without its last page")
    tracks, rate, size = {}, 0, 0
    for serial, own in packets.items():
        if not own or own[0][:8] != MAGIC:
            raise CorruptPage("unknown stream header")
        rate, k, size = struct.unpack_from("<IIQ", own[0], 8)
        tracks[k] = own[1:]
    order = [tracks[i % 2][i // 2] for i in range(sum(map(len, tracks.values())))]
    payload = b"".join(order)
    if len(payload) != size:
        raise CorruptPage("samples lost")
    for serial in packets:
        if max((g for s, g in granules if s == serial), default=0) != sum(map(len, packets[serial][1:])):
            raise CorruptPage("granule position doesn't match the samples")
    times = [(serial, g / rate) for serial, g in granules]
    return payload, {"pages": pages, "packets": sum(map(len, packets.values())), "seconds": max((t for _, t in times), default=0.0), "times": times}


def features(payload: bytes) -> str:
    """Mean, energy, zero crossings and spread of the samples, as whole numbers."""
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    n = len(samples)
    crossings = int(((samples[1:] >= 0) != (samples[:-1] >= 0)).sum())
    return f"mean={int(samples.sum()) * 1000 // n};energy={int((samples**2).sum()) * 1000 // n};crossings={crossings};low={int(samples.min())};high={int(samples.max())}"


def media_columns(docs: DataFrame) -> DataFrame:
    """RESULT per row of docs(doc_id, text): the text's bytes as media, read back and measured."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), 1000):
                out = []
                for doc, text in zip(frame["id"][begin : begin + 1000], frame["text"][begin : begin + 1000]):
                    data = text.encode()
                    media = packed(data.ljust(max(1, -(-len(data) // UNIT)) * UNIT))
                    payload, facts = unpacked(media)
                    out.append(
                        (doc, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload), facts["pages"], facts["packets"], facts["seconds"], media)
                    )
                made = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
                made["doc_id"] = ids(made["doc_id"])
                yield made

    plain = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    return plain.mapInPandas(run, RESULT)


def op3_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir)).drop("media")
