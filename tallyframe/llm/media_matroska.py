"""Matroska media columns: files are written from bytes and parsed into packet tables.

`mux` stores bytes as 8-bit mono PCM: an EBML header, then a segment with info, one track, clusters and cues. Frames of
FRAME samples go into blocks of up to LACED frames: laced with fixed sizes where all are equal, with Xiph sizes where
there are two, and with EBML sizes (differences of variable-length integers) otherwise; a single frame isn't laced.

`parse` reads any file of that structure by its elements: variable-length ids and sizes, unknown sizes of segments and
clusters, both kinds of block, all kinds of lacing, elements that it doesn't know (skipped). It gives tracks, cues and
a packet for each frame: track, timestamp, and the byte range in the file, so that a payload is cut out of the file
by ranges alone.

Defined cases: a null text counts as empty; a payload is padded with zero bytes to a positive multiple of 64, so an
empty text has 64 of them. Equal texts give equal files. A file that ends early or has no segment raises ValueError
from `parse`; `packets` gives such rows, and null ones, no packets and the reason in `error`. An empty table gives an
empty result. Columns beyond id and text (or media) are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import map_arrow, table

#: Element ids of the Matroska format (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

#: Samples a second and a frame, frames a block, blocks a cluster. A sample is 1/8 ms, a frame 128 ms.
RATE, FRAME, LACED, BLOCKS = 8000, 1024, 8, 16

UNIT = 64


def vint(value: int, width: int = 0) -> bytes:
    """value as a variable-length integer, of the least width or the one given; all ones is kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(ident: int, value: float) -> bytes:
    return element(ident, struct.pack(">d", value))


def laced(frames: list[bytes]) -> tuple[int, bytes]:
    """The lacing flag and the body of a block: 0 none, 1 Xiph, 3 EBML, 2 fixed."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes, head, body = [len(f) for f in frames], bytes([len(frames) - 1]), b"".join(frames)
    if len(set(sizes)) == 1:
        return 2, head + body
    if len(frames) == 2:
        return 1, head + b"\xff" * (sizes[0] // 255) + bytes([sizes[0] % 255]) + body
    steps = b""
    for a, b in zip(sizes, sizes[1:-1]):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        steps += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return 3, head + vint(sizes[0]) + steps + body


def mux(payload: bytes) -> bytes:
    """A Matroska file that holds payload as the samples of its one track."""
    header = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, len(payload) * 1000 / RATE) + element(MUXING_APP, b"tallyframe") + element(WRITING_APP, b"tallyframe"))
    audio = element(AUDIO, real(SAMPLING_FREQUENCY, float(RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    step = FRAME * LACED * BLOCKS
    for start in range(0, len(payload), step):
        time, blocks = start * 1000 // RATE, [number(TIMESTAMP, start * 1000 // RATE)]
        for first in range(start, min(start + step, len(payload)), FRAME * LACED):
            last = min(first + FRAME * LACED, start + step, len(payload))
            lacing, body = laced([payload[i : min(i + FRAME, last)] for i in range(first, last, FRAME)])
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", first * 1000 // RATE - time, 0x80 | lacing << 1) + body))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    return header + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


@dataclass
class Media:
    """What a file holds. tracks: number to (codec, rate, channels, bits); cues: (time, track, byte of the cluster);
    packets: (track, timestamp in scale units, first byte, size, key, lacing, block)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, tuple[str, float, int, int]] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    blocks: int = 0

    def payload(self, data: bytes, track: int) -> bytes:
        return b"".join([data[p[2] : p[2] + p[3]] for p in self.packets if p[0] == track])


def _width(data: bytes, at: int) -> int:
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    return 9 - data[at].bit_length()


def read_vint(data: bytes, at: int) -> tuple[int | None, int]:
    """The integer at a byte, None for an unknown size, and the byte after it."""
    width = _width(data, at)
    if at + width > len(data):
        raise ValueError(f"the file ends inside the integer at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") ^ (1 << 7 * width)
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end byte) of the elements in a range; one of unknown size ends with the range, a cluster with the next element of a segment."""
    while at < end:
        width = _width(data, at)
        ident = int.from_bytes(data[at : at + width], "big")
        size, start = read_vint(data, at + width)
        at = end if size is None else start + size
        if at > end:
            raise ValueError(f"element {ident:x} at byte {start} ends after its parent")
        if size is None and ident == CLUSTER:
            at = _before(data, start, end)
        yield ident, start, at


def _before(data: bytes, at: int, end: int) -> int:
    """Where, from a byte on, the first element that only a segment holds starts."""
    while at < end:
        width = _width(data, at)
        if int.from_bytes(data[at : at + width], "big") in (CLUSTER, CUES, TRACKS, INFO, SEGMENT):
            return at
        size, start = read_vint(data, at + width)
        at = end if size is None else start + size
    return end


def _block(data: bytes, at: int, end: int, time: int, key: bool | None, media: Media) -> None:
    track, at = read_vint(data, at)
    if at + 3 > end:
        raise ValueError("a block ends inside its header")
    offset, flags = struct.unpack_from(">hB", data, at)
    at, lacing, sizes = at + 3, flags >> 1 & 3, []
    if lacing:
        frames, at = data[at] + 1, at + 1
        if lacing == 1:
            for _ in range(frames - 1):
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                sizes.append(size + data[at])
                at += 1
        elif lacing == 3 and frames > 1:
            size, at = read_vint(data, at)
            sizes.append(size or 0)
            for _ in range(frames - 2):
                width = _width(data, at)
                step = int.from_bytes(data[at : at + width], "big") ^ (1 << 7 * width)
                sizes.append(sizes[-1] + step - ((1 << 7 * width - 1) - 1))
                at += width
        elif lacing == 2:
            sizes = [(end - at) // frames] * (frames - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a block's frames are longer than the block")
    step = 0
    for size in sizes:  # the frames of a lace have no timestamps of their own: samples before them give the time
        media.packets.append((track or 0, time + offset + step, at, size, bool(flags & 0x80) if key is None else key, lacing, media.blocks))
        kind = media.tracks.get(track or 0)
        if kind and kind[1] and kind[2] and kind[3] >= 8:
            step += round(size * 8 * 10**9 / (kind[1] * kind[2] * kind[3] * media.scale))
        at += size
    media.blocks += 1


def parse(data: bytes) -> Media:
    """The tracks, cues and packets of a Matroska file."""
    whole = lambda a, b: int.from_bytes(data[a:b], "big")
    point = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0
    media, found = Media(), False
    for top, start, end in elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        found = True
        for kind, a, b in elements(data, start, end):
            if kind == INFO:
                for i, x, y in elements(data, a, b):
                    media.scale = whole(x, y) if i == TIMESTAMP_SCALE else media.scale
                    media.duration = point(x, y) if i == DURATION else media.duration
            elif kind == TRACKS:
                for entry in (e for e in elements(data, a, b) if e[0] == TRACK_ENTRY):
                    n, codec, rate, channels, bits = 0, "", 0.0, 1, 0
                    for i, x, y in elements(data, entry[1], entry[2]):
                        n, codec = (whole(x, y), codec) if i == TRACK_NUMBER else (n, data[x:y].decode("ascii", "replace")) if i == CODEC_ID else (n, codec)
                        for j, p, q in elements(data, x, y) if i == AUDIO else ():
                            rate = point(p, q) if j == SAMPLING_FREQUENCY else rate
                            channels = whole(p, q) if j == CHANNELS else channels
                            bits = whole(p, q) if j == BIT_DEPTH else bits
                    media.tracks[n] = (codec, rate, channels, bits)
            elif kind == CLUSTER:
                media.clusters.append(a - start)
                time = 0
                for i, x, y in elements(data, a, b):
                    if i == TIMESTAMP:
                        time = whole(x, y)
                    elif i == SIMPLE_BLOCK:
                        _block(data, x, y, time, None, media)
                    elif i == BLOCK_GROUP:
                        for j, p, q in elements(data, x, y):
                            if j == BLOCK:
                                _block(data, p, q, time, True, media)
            elif kind == CUES:
                for cue in (e for e in elements(data, a, b) if e[0] == CUE_POINT):
                    time, places = 0, []
                    for i, x, y in elements(data, cue[1], cue[2]):
                        if i == CUE_TIME:
                            time = whole(x, y)
                        elif i == CUE_POSITIONS:
                            place = {j: whole(p, q) for j, p, q in elements(data, x, y)}
                            places.append((place.get(CUE_TRACK, 0), place.get(CUE_CLUSTER, 0)))
                    media.cues += [(time, track, at) for track, at in places]
    if not found:
        raise ValueError("the file has no segment")
    return media


def padded(text: str | None) -> tuple[int, bytes]:
    """The number of UTF-8 bytes of a text, and these with zero bytes up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "replace")
    return len(data), data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0")


def feature(media: Media, payload: bytes) -> str:
    """Counts of the container, the duration in ms, and of the samples the sum, the range and the crossings of the middle."""
    samples = np.frombuffer(payload, np.uint8)
    crossings = int(np.count_nonzero(np.diff(samples >= 128)))
    lacings = "".join(str(sum(p[5] == k for p in media.packets)) + ("/" if k < 3 else "") for k in range(4))
    return f"clusters={len(media.clusters)} cues={len(media.cues)} blocks={media.blocks} packets={len(media.packets)} lacing={lacings} ms={round(media.duration * media.scale / 1e6)} sum={int(samples.sum(dtype=np.int64))} min={int(samples.min(initial=255))} max={int(samples.max(initial=0))} crossings={crossings}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a Matroska file."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [padded(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([mux(p) for _, p in found], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, track, codec, timestamp_ns, first_byte, size, key, lacing, block, error): a row for each packet of each file."""
    rows = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    schema = pa.schema([("track", pa.int64()), ("codec", pa.string()), ("timestamp_ns", pa.int64()), ("first_byte", pa.int64()), ("size", pa.int64()), ("key", pa.bool_()), ("lacing", pa.int32()), ("block", pa.int64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for k, cell in enumerate(batch.column(1)):
                data = cell.as_py()
                try:
                    if data is None:
                        raise ValueError("null")
                    parsed = parse(data)
                    rest = [(p[0], parsed.tracks.get(p[0], ("",))[0], p[1] * parsed.scale, *p[2:], None) for p in parsed.packets]
                except (ValueError, IndexError, struct.error) as e:
                    rest = [(None,) * 8 + (str(e) or type(e).__name__,)]
                owner += [k] * len(rest)
                found += [dict(zip(schema.names, r)) for r in rest]
            part = pa.RecordBatch.from_pylist(found, schema)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *part.columns], ["doc_id", *schema.names])

    kinds = "track long, codec string, timestamp_ns long, first_byte long, size long, key boolean, lacing int, block long, error string"
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kinds}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored, read back from the stored bytes by its packets, and described; see op7 for the columns."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cell in batch.column(1):
                n, payload = padded(cell.as_py())
                data = mux(payload)
                media = parse(data)
                back = media.payload(data, 1)
                found.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, back)))
            columns = zip(*found) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], ["doc_id", *names])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
