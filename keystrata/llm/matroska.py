"""Matroska media columns.

``mux`` writes samples into a Matroska file (PCM, one track, laced simple
blocks, clusters, cues); ``parse`` reads any Matroska bytes: variable-length
EBML elements, known and unknown sizes, clusters, simple and grouped blocks,
the three kinds of lacing, and cues. ``packet_table`` and ``cue_table`` turn a
media column into rows with track, timestamp and byte range.

Cases: a null media value gives no packets; bytes that break off or are not
Matroska give the packets before the fault and a message in ``error``; in the
round trip a null text counts as empty, whose payload is one block of zero
bytes; a value of any length is parsed whole; a file of several segments has
its times and offsets by segment; rows that share a doc_id, or have none, stay separate; an empty table
yields no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_slices, materialize, text_slices, whole_texts

# Element ids of the Matroska format.
EBML = 0x1A45DFA3
EBML_VERSION = 0x4286
EBML_READ_VERSION = 0x42F7
EBML_MAX_ID = 0x42F2
EBML_MAX_SIZE = 0x42F3
DOC_TYPE = 0x4282
DOC_TYPE_VERSION = 0x4287
DOC_TYPE_READ_VERSION = 0x4285
SEGMENT = 0x18538067
INFO = 0x1549A966
TIMESTAMP_SCALE = 0x2AD7B1
DURATION = 0x4489
MUXING_APP = 0x4D80
WRITING_APP = 0x5741
TRACKS = 0x1654AE6B
TRACK_ENTRY = 0xAE
TRACK_NUMBER = 0xD7
TRACK_UID = 0x73C5
TRACK_TYPE = 0x83
FLAG_LACING = 0x9C
DEFAULT_DURATION = 0x23E383
CODEC_ID = 0x86
AUDIO = 0xE1
SAMPLING_FREQUENCY = 0xB5
CHANNELS = 0x9F
BIT_DEPTH = 0x6264
CLUSTER = 0x1F43B675
TIMESTAMP = 0xE7
SIMPLE_BLOCK = 0xA3
BLOCK_GROUP = 0xA0
BLOCK = 0xA1
REFERENCE_BLOCK = 0xFB
CUES = 0x1C53BB6B
CUE_POINT = 0xBB
CUE_TIME = 0xB3
CUE_TRACK_POSITIONS = 0xB7
CUE_TRACK = 0xF7
CUE_CLUSTER_POSITION = 0xF1
SEEK_HEAD = 0x114D9B74
TAGS = 0x1254C367
CHAPTERS = 0x1043A770
ATTACHMENTS = 0x1941A469

MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS, EBML}
#: What ends a cluster or a segment of unknown size.
TOP = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, SEGMENT, EBML}

RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 8  # samples a second, bytes a frame, frames a block, blocks a cluster


# ---------------------------------------------------------------- writing


def _id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(i: int, body: bytes) -> bytes:
    return _id(i) + _size(len(body)) + body


def _uint(i: int, n: int) -> bytes:
    return _element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed_size(n: int) -> bytes:
    """A size difference: the same code, shifted so that zero is its middle."""
    width = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1))
    return _size(n + (1 << 7 * width - 1) - 1, width)


def _block(track: int, ticks: int, frames: list[bytes], lacing: str) -> bytes:
    """Lacing is 'fixed' where the frames are equal, else the kind asked for."""
    if len(frames) == 1:
        kind, head = 0, b""
    elif len({len(f) for f in frames}) == 1:
        kind, head = 2, bytes([len(frames) - 1])
    elif lacing == "xiph":
        kind = 1
        head = bytes([len(frames) - 1]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    else:
        sizes = [len(f) for f in frames[:-1]]
        kind = 3
        head = bytes([len(frames) - 1]) + _size(sizes[0]) + b"".join(_signed_size(b - a) for a, b in zip(sizes, sizes[1:], strict=False))
    return _size(track) + struct.pack(">hB", ticks, 0x80 | kind << 1) + head + b"".join(frames)


_HEAD = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, FRAME * 10**9 // RATE) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def mux(samples: bytes, lacing: str = "ebml") -> bytes:
    """A Matroska file that holds ``samples`` as 8-bit PCM."""
    frames = [samples[i : i + FRAME] for i in range(0, len(samples), FRAME)]
    ticks_a_frame = FRAME * 1000 // RATE
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 10**6) + _element(DURATION, struct.pack(">d", len(samples) * 1000 / RATE)) + _element(MUXING_APP, b"keystrata") + _element(WRITING_APP, b"keystrata"))
    body, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    step = LACED * BLOCKS
    for c in range(0, len(frames), step):
        own = [_uint(TIMESTAMP, c * ticks_a_frame)]
        for b in range(c, min(c + step, len(frames)), LACED):
            own.append(_element(SIMPLE_BLOCK, _block(1, (b - c) * ticks_a_frame, frames[b : min(b + LACED, c + step)], lacing)))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, c * ticks_a_frame) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        cluster = _element(CLUSTER, b"".join(own))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(body))


# ---------------------------------------------------------------- reading


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    length: int
    keyframe: bool
    cluster: int
    lace: int


class Media(NamedTuple):
    tracks: dict[int, dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # timestamp in ns, track, the cluster's offset in the file
    error: str | None


def _vint(data: bytes, at: int, end: int, keep: bool) -> tuple[int, int, bool]:
    """Value, place after it, and whether all its bits are set (unknown size)."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"broken off at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    value = n & (1 << 7 * width) - 1
    return (n if keep else value), at + width, value == (1 << 7 * width) - 1


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if kind == 0:
        return [(at, end - at)]
    if at >= end:
        raise ValueError(f"lacing without a count at {at}")
    count, at = data[at] + 1, at + 1
    if kind == 2:
        each, rest = divmod(end - at, count)
        if rest:
            raise ValueError(f"unequal frames in fixed lacing at {at}")
        return [(at + i * each, each) for i in range(count)]
    sizes: list[int] = []
    while len(sizes) < count - 1:
        if kind == 1:
            n = 0
            while True:
                if at >= end:
                    raise ValueError(f"broken off at {at}")
                n, at = n + data[at], at + 1
                if data[at - 1] < 255:
                    break
        else:
            n, after, _ = _vint(data, at, end, False)
            if sizes:
                n += sizes[-1] - (1 << 7 * (after - at) - 1) + 1
            at = after
        if n < 0:
            raise ValueError(f"negative frame size at {at}")
        sizes.append(n)
    last = end - at - sum(sizes)
    if last < 0:
        raise ValueError(f"frames longer than their block at {at}")
    out = []
    for n in [*sizes, last]:
        out.append((at, n))
        at += n
    return out


def parse(data: bytes) -> Media:
    tracks: dict[int, dict] = {}
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    # clusters, cues and tracks may come in any order: scale and durations are applied at the end
    state = {"base": 0, "segment": 0, "part": -1, "clusters": -1}
    blocks: list[tuple[int, int, bool, int, list[tuple[int, int]], int]] = []
    raw_cues: list[tuple[dict, int, int]] = []  # with the segment's first byte and number
    scales: dict[int, int] = {}
    steps: dict[tuple[int, int], int] = {}  # a frame's duration by segment and track

    def block(at: int, end: int, simple: bool) -> None:
        track, at, _ = _vint(data, at, end, False)
        if at + 3 > end:
            raise ValueError(f"broken off at {at}")
        ticks, flags = struct.unpack_from(">hB", data, at)
        blocks.append((track, state["base"] + ticks, bool(flags & 0x80) if simple else True, state["clusters"], _frames(data, at + 3, end, flags >> 1 & 3), state["part"]))

    def inside(at: int, end: int, owner: int, here: dict) -> int:
        while at < end:
            start = at
            i, at, _ = _vint(data, at, end, True)
            if here.get("open") and (owner == CLUSTER and i in TOP or owner == SEGMENT and i in (SEGMENT, EBML)):
                return start
            n, at, unknown = _vint(data, at, end, False)
            stop = end if unknown else at + n
            if stop > end:
                raise ValueError(f"element {i:x} at {start} is longer than what holds it")
            if i == SEGMENT:
                state["segment"] = at
                state["part"] += 1
            elif i == CLUSTER:
                state["clusters"] += 1
                state["base"] = 0
            if i in MASTERS:
                own: dict = {"open": unknown}
                at = inside(at, stop, i, own)
                if i == TRACK_ENTRY:
                    tracks[own.get(TRACK_NUMBER, 0)] = own
                    steps[state["part"], own.get(TRACK_NUMBER, 0)] = own.get(DEFAULT_DURATION, 0)
                elif i == AUDIO:
                    here.update(own)
                elif i == CUE_TRACK_POSITIONS:
                    here.setdefault("positions", []).append(own)
                elif i == CUE_POINT:
                    raw_cues.extend(({CUE_TIME: own.get(CUE_TIME, 0), **p}, state["segment"], state["part"]) for p in own.get("positions", []))
                elif i == BLOCK_GROUP and REFERENCE_BLOCK in own and blocks:
                    blocks[-1] = (*blocks[-1][:2], False, *blocks[-1][3:])
                elif i == INFO:
                    scales[state["part"]] = own.get(TIMESTAMP_SCALE, 10**6)
                continue
            if i in (SIMPLE_BLOCK, BLOCK):
                block(at, stop, i == SIMPLE_BLOCK)
            elif i in (SAMPLING_FREQUENCY, DURATION):
                here[i] = struct.unpack(">f" if n == 4 else ">d", data[at:stop])[0] if n in (4, 8) else 0.0
            elif i == CODEC_ID:
                here[i] = data[at:stop].decode("ascii", "replace")
            elif n <= 8:
                here[i] = int.from_bytes(data[at:stop], "big")
                if i == TIMESTAMP and owner == CLUSTER:
                    state["base"] = here[i]
            at = stop
        return at

    error = None
    try:
        if data[:4] != _id(EBML):
            raise ValueError("no EBML header")
        inside(0, len(data), 0, {})
    except (ValueError, RecursionError) as e:
        error = str(e)
    for track, ticks, key, cluster, ranges, part in blocks:
        step, scale = steps.get((part, track), 0), scales.get(part, 10**6)
        packets += [Packet(track, ticks * scale + k * step, at, n, key, cluster, k) for k, (at, n) in enumerate(ranges)]
    for c, first, part in raw_cues:
        cues.append((c[CUE_TIME] * scales.get(part, 10**6), c.get(CUE_TRACK, 0), first + c.get(CUE_CLUSTER_POSITION, 0)))
    return Media(tracks, packets, cues, error)


# ---------------------------------------------------------------- tables


def _media_rows(media: DataFrame, schema: str, rows_of) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batch):
        out: list[list] = [[] for _ in names]
        for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            if data is not None:
                for row in rows_of(parse(data)):
                    for column, v in zip(out, (doc, *row), strict=True):
                        column.append(v)
        kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[x.split()[1]]) for v, x in zip(out, schema.split(", "), strict=True)], names=names)

    return map_slices(media.select("doc_id", "media"), each, schema, "media")


def packet_table(media: DataFrame) -> DataFrame:
    """A row for each packet of the column ``media``, keyed by doc_id."""
    return _media_rows(media, "doc_id long, packet int, track int, timestamp_ns long, offset long, length long, keyframe boolean, cluster int, lace int, error string", lambda m: [(k, p.track, p.timestamp_ns, p.offset, p.length, p.keyframe, p.cluster, p.lace, m.error) for k, p in enumerate(m.packets)])


def cue_table(media: DataFrame) -> DataFrame:
    """A row for each cue: its time, track and the byte at which its cluster begins."""
    return _media_rows(media, "doc_id long, timestamp_ns long, track int, cluster_offset long", lambda m: m.cues)


def text_media(docs: DataFrame) -> DataFrame:
    """Each whole text as media: doc_id, n_bytes, media."""

    def run(batches):
        for batch in text_slices(batches):
            payloads = [x.encode() for x in batch.column("text").to_pylist()]
            media = [mux(p + bytes(-len(p) % 64 if p else 64)) for p in payloads]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(p) for p in payloads], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return whole_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature(samples: bytes, media: Media) -> str:
    """Packets, clusters, milliseconds, mean and mean square of the samples
    about their middle, and crossings of it."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    ends = Counter(p.cluster for p in media.packets)
    crossings = int(np.count_nonzero(np.diff(x >= 0)))
    return f"packets={len(media.packets)};clusters={len(ends)};ms={len(x) * 1000 // RATE};mean={int(x.sum()) // max(1, len(x))};power={int((x * x).sum()) // max(1, len(x))};crossings={crossings}"


def media_digests(media: DataFrame) -> DataFrame:
    """Rebuild each payload from its packets' byte ranges and describe it; a
    cue that does not point at a cluster is an error."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_cues long"

    def each(batch):
        out = []
        for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
            m = parse(data)
            if m.error:
                raise ValueError(m.error)
            if any(data[at : at + 4] != _id(CLUSTER) for *_, at in m.cues):
                raise ValueError("a cue points beside its cluster")
            payload = b"".join(data[p.offset : p.offset + p.length] for p in m.packets)
            out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, m), len(m.packets), len(m.cues)))
        kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return map_slices(media.select("doc_id", "n_bytes", "media"), each, schema, "media")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the texts' media to the shared folder, read it back, describe it."""
    return media_digests(materialize(text_media(docs)))
