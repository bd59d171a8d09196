"""Media columns in Matroska: a writer of 8-bit PCM, and a reader that makes packet tables.

The reader walks variable-length EBML elements, takes the segment's tracks,
clusters (of known or unknown size), SimpleBlocks and BlockGroups with all four
kinds of lacing, and the cues, and gives every frame's track, timestamp and byte
range. The writer stores a payload as unsigned 8-bit mono samples, a fixed number
of samples a frame, frames laced into blocks, blocks gathered in clusters, a cue
for each cluster.

Defined results: a null text is empty. A payload is padded with bytes 255 to a
positive multiple of the frame size, so an empty text has one frame. Equal texts
have equal media. A null or damaged media value has no packets and its error says
why. Repeated rows are kept; an empty table gives an empty one; other columns are
ignored.
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

from .common import small_batches, table

# Fixed values of the format: element ids.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: What ends a cluster of unknown size: the other children of a segment.
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367, SEGMENT, EBML}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME, RATE = 576, 8000
MILLISECOND = 1_000_000


class MatroskaError(ValueError):
    pass


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    length: int
    cluster: int
    lace: int
    keyframe: bool


@dataclass
class Media:
    scale: int = MILLISECOND
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


# --- writing


def _vint(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + _vint(len(body)) + body


def _uint(key: int, n: int) -> bytes:
    return _element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(key: int, x: float) -> bytes:
    return _element(key, struct.pack(">d", x))


def _lace_sizes(sizes: list[int], lacing: int) -> bytes:
    if lacing == FIXED:
        return b""
    if lacing == XIPH:
        return b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    out = _vint(sizes[0])
    for before, n in zip(sizes, sizes[1:-1]):
        width = next(w for w in range(1, 9) if abs(n - before) < (1 << 7 * w - 1) - 1)
        out += _vint(n - before + (1 << 7 * width - 1) - 1, width)
    return out


def block(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    """The body of a SimpleBlock."""
    lacing = lacing if len(frames) > 1 else NO_LACING
    head = _vint(track) + struct.pack(">hB", relative, 0x80 | lacing_bits(lacing))
    if lacing != NO_LACING:
        head += bytes([len(frames) - 1]) + _lace_sizes([len(f) for f in frames], lacing)
    return head + b"".join(frames)


def lacing_bits(lacing: int) -> int:
    return {NO_LACING: 0, XIPH: 0x02, FIXED: 0x04, EBML_LACING: 0x06}[lacing]


def write_pcm(payload: bytes, frame: int = FRAME, rate: int = RATE, frames_a_block: int = 8, blocks_a_cluster: int = 32, lacing: int = EBML_LACING) -> bytes:
    """A Matroska file of the payload as unsigned 8-bit mono samples."""
    if len(payload) % frame:
        raise MatroskaError("the payload isn't a multiple of the frame size")
    frames_a_block = frames_a_block if lacing != NO_LACING else 1
    step = blocks_a_cluster * frames_a_block * frame
    ms = lambda sample: sample * 1000 // rate
    info = _element(INFO, _uint(TIMESTAMP_SCALE, MILLISECOND) + _float(DURATION, float(ms(len(payload)))))
    audio = _element(AUDIO, _float(SAMPLING_FREQUENCY, float(rate)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, frame * 10**9 // rate) + audio
    body = [info, _element(TRACKS, _element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, body)), []
    for a in range(0, len(payload), step):
        part, blocks = payload[a : a + step], [_uint(TIMESTAMP, ms(a))]
        for b in range(0, len(part), frames_a_block * frame):
            laced = part[b : b + frames_a_block * frame]
            frames = [laced[i : i + frame] for i in range(0, len(laced), frame)]
            blocks.append(_element(SIMPLE_BLOCK, block(1, ms(a + b) - ms(a), frames, lacing)))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, ms(a)) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        body.append(_element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    body.append(_element(CUES, b"".join(cues)))
    return _element(EBML, _element(DOC_TYPE, b"matroska")) + _element(SEGMENT, b"".join(body))


# --- reading


def _number(data: memoryview, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """A variable-length number: its value, the place after it, whether all its bits are set (an unknown size)."""
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MatroskaError(f"the file ends in a number at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    bare = n & ((1 << 7 * width) - 1)
    return (n if keep_marker else bare), at + width, bare == (1 << 7 * width) - 1


def elements(data: memoryview, at: int, end: int, until: set[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of the elements between two places; an element of unknown size ends with its parent, or before an id in TOP_LEVEL if it's a cluster."""
    while at < end:
        start = at
        key, at, _ = _number(data, at, True)
        if key in until:
            return
        n, at, unknown = _number(data, at, False)
        stop = end if unknown else at + n
        if unknown and key == CLUSTER:
            stop = at
            for _, _, stop_at in elements(data, at, end, TOP_LEVEL):
                stop = stop_at
        if stop > end:
            raise MatroskaError(f"the element at byte {start} is longer than what holds it")
        yield key, at, stop
        at = stop


def _read_uint(data: memoryview, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _read_float(data: memoryview, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise MatroskaError(f"a float of {b - a} bytes")
    return 0.0 if a == b else struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]


def _frames(data: memoryview, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and the frames' byte ranges of a block."""
    track, at, _ = _number(data, at, False)
    if at + 3 > end:
        raise MatroskaError(f"the block at byte {at} is too short")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    at += 3
    if not flags & 0x06:
        return track, relative, flags, [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if flags & 0x06 == 0x04:
        if (end - at) % n:
            raise MatroskaError(f"fixed lacing of {n} frames in {end - at} bytes")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for k in range(n - 1):
            if flags & 0x06 == 0x02:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                width_at = at
                size, at, _ = _number(data, at, False)
                if k:
                    size += sizes[-1] - ((1 << 7 * (at - width_at) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError(f"the laces of the block at byte {at} exceed it")
    found = []
    for size in sizes:
        found.append((at, size))
        at += size
    return track, relative, flags, found


def _read_track(data: memoryview, a: int, b: int) -> dict:
    track = {"number": 0, "codec": "", "type": 0, "default_duration": 0, "rate": 8000.0, "channels": 1, "bits": 0}
    for key, x, y in elements(data, a, b):
        if key == CODEC_ID:
            track["codec"] = bytes(data[x:y]).decode("ascii", "replace").rstrip("\0")
        elif key == AUDIO:
            for own, c, d in elements(data, x, y):
                if own == SAMPLING_FREQUENCY:
                    track["rate"] = _read_float(data, c, d)
                elif own in (CHANNELS, BIT_DEPTH):
                    track["channels" if own == CHANNELS else "bits"] = _read_uint(data, c, d)
        elif name := {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}.get(key):
            track[name] = _read_uint(data, x, y)
    return track


def read_media(blob: bytes) -> Media:
    """Tracks, packets and cues of a Matroska file; MatroskaError if it is damaged."""
    data, media = memoryview(blob), Media()
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise MatroskaError("no EBML header")
    for _, segment, end in (x for x in top if x[0] == SEGMENT):
        for key, a, b in elements(data, segment, end):
            if key == INFO:
                for own, c, d in elements(data, a, b):
                    if own == TIMESTAMP_SCALE:
                        media.scale = _read_uint(data, c, d)
                    elif own == DURATION:
                        media.duration = _read_float(data, c, d)
            elif key == TRACKS:
                for own, c, d in elements(data, a, b):
                    if own == TRACK_ENTRY:
                        track = _read_track(data, c, d)
                        media.tracks[track["number"]] = track
            elif key == CLUSTER:
                media.clusters.append(a)
                _read_cluster(data, a, b, media)
            elif key == CUES:
                for _, c, d in (x for x in elements(data, a, b) if x[0] == CUE_POINT):
                    time, places = 0, []
                    for own, e, f in elements(data, c, d):
                        if own == CUE_TIME:
                            time = _read_uint(data, e, f)
                        elif own == CUE_TRACK_POSITIONS:
                            found = {k: _read_uint(data, g, h) for k, g, h in elements(data, e, f) if k in (CUE_TRACK, CUE_CLUSTER_POSITION)}
                            places.append((found.get(CUE_TRACK, 0), segment + found.get(CUE_CLUSTER_POSITION, 0)))
                    media.cues += [(time * media.scale, track, place) for track, place in places]
    return media


def _read_cluster(data: memoryview, a: int, b: int, media: Media) -> None:
    time = 0
    for key, x, y in elements(data, a, b):
        if key == TIMESTAMP:
            time = _read_uint(data, x, y)
            continue
        blocks = [(x, y)] if key == SIMPLE_BLOCK else [(c, d) for own, c, d in elements(data, x, y) if own == BLOCK] if key == BLOCK_GROUP else []
        for c, d in blocks:
            track, relative, flags, frames = _frames(data, c, d)
            step = media.tracks.get(track, {}).get("default_duration", 0)
            # Fields of eight bytes, as tables have them.
            if track >= 1 << 63 or not -(1 << 63) <= (time + relative) * media.scale <= (1 << 63) - 1 - len(frames) * step:
                raise MatroskaError(f"the block at byte {c} has a track or a time beyond 64 bits")
            for lace, (at, size) in enumerate(frames):
                media.packets.append(Packet(track, (time + relative) * media.scale + lace * step, at, size, len(media.clusters) - 1, lace, bool(flags & 0x80) if key == SIMPLE_BLOCK else True))


def seek(media: Media, timestamp_ns: int, track: int = 1) -> int | None:
    """The place of the cluster that a player reads first to show this time."""
    before = [(t, place) for t, own, place in media.cues if own == track and t <= timestamp_ns]
    return max(before)[1] if before else None


def payload_of(blob: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([blob[p.offset : p.offset + p.length] for p in media.packets if p.track == track])


def features(media: Media, payload: bytes) -> str:
    """Whole numbers only, so that every machine writes the same: counts, duration, sums and crossings of the mid level."""
    samples = np.frombuffer(payload, np.uint8)
    level = samples >= 128
    total, square = int(samples.sum(dtype=np.int64)), int(np.bincount(samples, minlength=256) @ (np.arange(256, dtype=np.int64) ** 2))
    last = media.packets[-1].timestamp_ns if media.packets else 0
    return f"codec={media.tracks.get(1, {}).get('codec', '')};packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};last_ns={last};sum={total};squares={square};crossings={int((level[1:] != level[:-1]).sum())}"


# --- columns

PACKETS = "track long, codec string, timestamp_ns long, offset long, length long, cluster int, lace int, keyframe boolean"
#: Packets that are handed on at a time.
PACKETS_A_BATCH = 1 << 16


def pad(text: str | None, frame: int = FRAME) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % frame or (0 if raw else frame))


def text_media(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """doc_id, n_bytes and a binary media column for docs(doc_id, text)."""
    small_batches(docs.sparkSession, 256)

    def write(batches):
        for batch in batches:
            padded = [pad(t, frame) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([n for n, _ in padded], pa.int64()), pa.array([write_pcm(p, frame) for _, p in padded], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


def packet_table(rows: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each packet of a binary column of Matroska files; a damaged one has a row with an error alone."""
    kind = rows.schema[key].dataType.simpleString()

    def read(batches):
        for batch in batches:
            types = (batch[key].type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            names = [key, "track", "codec", "timestamp_ns", "offset", "length", "cluster", "lace", "keyframe", "error"]
            rows_of = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
            out = []
            for k, blob in zip(batch[key].to_pylist(), batch[media].to_pylist()):
                try:
                    found = read_media(blob or b"")
                    out += [(k, p.track, found.tracks.get(p.track, {}).get("codec"), p.timestamp_ns, p.offset, p.length, p.cluster, p.lace, p.keyframe, None) for p in found.packets]
                except (MatroskaError, IndexError, OverflowError, struct.error) as e:
                    out.append((k, *[None] * 8, str(e)))
                if len(out) > PACKETS_A_BATCH:
                    yield rows_of(out)
                    out = []
            yield rows_of(out)

    return rows.select(key, media).mapInArrow(read, f"`{key}` {kind}, {PACKETS}, error string")


def media_digests(rows: DataFrame) -> DataFrame:
    """Digests of rows(doc_id, n_bytes, media), all read back from the stored bytes."""

    def read(batches):
        for batch in batches:
            out = []
            for doc, n, blob in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                found = read_media(blob)
                payload = payload_of(blob, found)
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), features(found, payload)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return rows.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, stored as Matroska and read back."""
    return media_digests(text_media(table(spark, sf_dir, "documents")))
