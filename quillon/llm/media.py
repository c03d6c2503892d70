"""Media columns: a Matroska writer and reader over binary columns.

``mux`` stores a byte payload as 8-bit PCM in one audio track: clusters of laced SimpleBlocks, and cues.
``demux`` walks the variable-length EBML elements of any Matroska file (known and unknown sizes,
SimpleBlock and BlockGroup, no, Xiph, fixed and EBML lacing) into packets with track, timestamp and byte range.

Defined results: a null text is stored as the empty payload; the payload is padded with zero bytes to a
positive multiple of 64; equal texts give equal media; a broken file gives no packets and an ``error`` text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bytes_of, checkpoint, column_of, map_pieces, pieces, record

# Element ids of the Matroska format.
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4287, 0x4285
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

RATE = 8000  # samples a second; a sample is a byte
FRAME = 1000  # bytes of a frame: 125 ms
LACED = 8  # frames of a block at most
BLOCKS = 16  # blocks of a cluster at most: 16 s, within a block's 16-bit time
UNIT = 64


def vint(value: int, width: int = 0) -> bytes:
    """An EBML size of the least width (or the given one) that holds the value and isn't all ones."""
    width = width or max(1, -(-(value + 1).bit_length() // 7))
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int) -> tuple[int, int]:
    """Value (-1: unknown size, all ones) and width of the EBML size at a position."""
    first = data[at]
    if not first:
        raise ValueError("a size of more than 8 bytes")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError("cut off in a size")
    ones = (1 << 7 * width) - 1
    value = int.from_bytes(data[at : at + width], "big") & ones
    return (-1 if value == ones else value), width


def read_id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise ValueError("not an element id")
    return int.from_bytes(data[at : at + width], "big"), width


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def signed_vint(value: int) -> bytes:
    """The EBML-lacing difference: a size shifted by half its range."""
    width = next(w for w in range(1, 9) if abs(value) < (1 << (7 * w - 1)) - 1)
    return vint(value + (1 << (7 * width - 1)) - 1, width)


def block_body(track: int, time: int, frames: list[bytes], lacing: int) -> bytes:
    """lacing: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    head = vint(track) + time.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1])
    if lacing:
        head += bytes([len(frames) - 1])
        sizes = [len(f) for f in frames]
        if lacing == 1:
            head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
        elif lacing == 3:
            head += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes[:-2], sizes[1:-1]))
    return head + b"".join(frames)


_HEAD = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
_INFO = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"quillon") + element(WRITING_APP, b"quillon"))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME * 10**9 // RATE)
        + element(AUDIO, element(SAMPLING, b"\x45\xfa\x00\x00") + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)),
    ),
)  # 0x45fa0000: 8000 as a 32-bit float


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    return payload + bytes(-len(payload) % unit if payload else unit)


def mux(payload: bytes) -> bytes:
    """The Matroska file whose one track's packets are the payload, in order."""
    body, cues = [_INFO, _TRACKS], []
    at = len(_INFO) + len(_TRACKS)
    span = FRAME * LACED
    for start in range(0, len(payload), span * BLOCKS):
        time = start * 1000 // RATE
        parts = [uint(TIMESTAMP, time)]
        for b in range(start, min(len(payload), start + span * BLOCKS), span):
            end = min(len(payload), b + span)
            frames = [payload[i : min(end, i + FRAME)] for i in range(b, end, FRAME)]
            lacing = 0 if len(frames) == 1 else 2 if len(frames[-1]) == FRAME else 3
            parts.append(element(SIMPLE_BLOCK, block_body(1, (b - start) * 1000 // RATE, frames, lacing)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    return _HEAD + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    """packets: (track, timestamp_ns, offset, size, keyframe, cluster, block, lace), in file order; cues: (time_ns, track, byte position of the cluster)."""

    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def demux(data: bytes) -> Media:
    out = Media()
    blocks: list[tuple[int, int, int, int, bool]] = []  # cluster's time, start, end, cluster, whether a SimpleBlock
    segment, cluster_time, track, cue = 0, 0, {}, [0, 0, 0]
    stack = [(len(data), 0)]  # end, id
    at = 0
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    while at < len(data):
        while len(stack) > 1 and at >= stack[-1][0]:
            stack.pop()
        start = at
        kind, w = read_id(data, at)
        size, w2 = read_vint(data, at + w)
        at += w + w2
        if kind == CLUSTER or kind in TOP_LEVEL:  # ends a cluster of unknown size
            while len(stack) > 1 and stack[-1][1] == CLUSTER:
                stack.pop()
        end = stack[-1][0] if size < 0 else at + size
        if end > stack[-1][0]:
            raise ValueError(f"element {kind:#x} at {start} goes beyond its parent")
        if kind in MASTERS:
            stack.append((end, kind))
            if kind == SEGMENT:
                segment = at
            elif kind == CLUSTER:
                out.clusters.append(start)
                cluster_time = 0
            elif kind == TRACK_ENTRY:
                track = {}
            elif kind == CUE_POINT:
                cue = [0, 0, 0]
            continue
        if kind == SIMPLE_BLOCK or kind == BLOCK:
            blocks.append((cluster_time, at, end, len(out.clusters) - 1, kind == SIMPLE_BLOCK))
        elif kind == TIMESTAMP and stack[-1][1] == CLUSTER:
            cluster_time = number(at, end)
        elif kind == TIMESTAMP_SCALE:
            out.scale = number(at, end)
        elif kind == TRACK_NUMBER:
            out.tracks[number(at, end)] = track
        elif kind in (TRACK_TYPE, DEFAULT_DURATION, CHANNELS, BIT_DEPTH):
            track[{TRACK_TYPE: "type", DEFAULT_DURATION: "frame_ns", CHANNELS: "channels", BIT_DEPTH: "bits"}[kind]] = number(at, end)
        elif kind == CODEC_ID:
            track["codec"] = data[at:end].decode("ascii", "replace")
        elif kind == SAMPLING:
            track["rate"] = float(np.frombuffer(data[at:end], ">f4" if end - at == 4 else ">f8")[0])
        elif kind == CUE_TIME:
            cue[0] = number(at, end)
        elif kind == CUE_TRACK:
            cue[1] = number(at, end)
        elif kind == CUE_CLUSTER_POSITION:
            cue[2] = number(at, end) + segment
            out.cues.append(tuple(cue))
        elif kind == EBML:
            stack.append((end, kind))
            continue
        elif kind == DOC_TYPE:
            out.doc_type = data[at:end].decode("ascii", "replace")
        at = end
    out.cues = [(t * out.scale, n, p) for t, n, p in out.cues]
    for k, (base, a, b, cluster, simple) in enumerate(blocks):
        number_, w = read_vint(data, a)
        if a + w + 3 > b:
            raise ValueError("cut off in a block's head")
        time = base + int.from_bytes(data[a + w : a + w + 2], "big", signed=True)
        flags = data[a + w + 2]
        step = out.tracks.get(number_, {}).get("frame_ns", 0)
        for lace, (x, y) in enumerate(laced(data, a + w + 3, b, flags >> 1 & 3)):
            out.packets.append((number_, time * out.scale + lace * step, x, y - x, bool(flags & 0x80) if simple else True, cluster, k, lace))
    return out


def laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if not lacing:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % n:
            raise ValueError("fixed lacing doesn't divide the block")
        sizes = [(end - at) // n] * n
    elif lacing == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                byte, at = data[at], at + 1
                size += byte
                if byte != 255:
                    break
            sizes.append(size)
    else:
        for i in range(n - 1):
            value, w = read_vint(data, at)
            at += w
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << (7 * w - 1)) - 1))
    if lacing != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError("laces go beyond the block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[o : o + n] for t, _, o, n, *_ in media.packets if t == track)


def feature(tracks: int, clusters: int, cues: int, packets: int, last_ns: int, payload: bytes) -> str:
    """What is computed from the stored form: packet table totals, and level, zero crossings and peak of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    rms = int(np.sqrt((x * x).mean()) * 1000)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"tracks={tracks} clusters={clusters} cues={cues} packets={packets} last_ns={last_ns} rms_milli={rms} crossings={crossings} peak={int(np.abs(x).max())}"


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text stored as a Matroska file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def run(piece: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or b"" for x in bytes_of(piece, text_col)]
            return pa.RecordBatch.from_arrays([column_of(piece, id_col), pa.array([len(x) for x in texts], pa.int64()), pa.array([mux(pad(x)) for x in texts], pa.binary())], names=[id_col, "n_bytes", "media"])

        return run

    return map_pieces(docs.select(id_col, text_col), text_col, make, f"`{id_col}` {kind}, n_bytes long, media binary")


_PACKET = [("track", pa.int64()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("cluster", pa.int32()), ("block", pa.int32()), ("lace", pa.int32())]
_CUE = [("time_ns", pa.int64()), ("track", pa.int64()), ("position", pa.int64())]


def _lists(rows: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    flat = list(zip(*(x for r in rows for x in r))) or [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(flat, fields)], names=[n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)


def read_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, packets, cues, clusters, tracks, error) of every stored file; a file that can't be read has an error and empty lists."""
    names = list(dict.fromkeys([id_col, *keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, media_col):
            found, errors = [], []
            for data in bytes_of(piece, media_col):
                try:
                    if not data:
                        raise ValueError("empty")
                    found.append(demux(data))
                    errors.append(None)
                except (ValueError, IndexError) as e:
                    found.append(Media())
                    errors.append(str(e))
            columns = [_lists([m.packets for m in found], _PACKET), _lists([m.cues for m in found], _CUE), pa.array([m.clusters for m in found], pa.list_(pa.int64())), pa.array([len(m.tracks) for m in found], pa.int32()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*(column_of(piece, c) for c in names), *columns], names=[*names, "packets", "cues", "clusters", "tracks", "error"])

    fields = [f"`{c}` {media.schema[c].dataType.simpleString()}" for c in names]
    packet = "struct<track:long,timestamp_ns:long,offset:long,size:long,keyframe:boolean,cluster:int,block:int,lace:int>"
    return media.select(*dict.fromkeys([*names, media_col])).mapInArrow(run, ", ".join([*fields, f"packets array<{packet}>", "cues array<struct<time_ns:long,track:long,position:long>>", "clusters array<long>", "tracks int", "error string"]))


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each packet; a file that can't be read gives one row with its error and a null byte range."""
    read = read_media(media, id_col, media_col).where((F.size("packets") > 0) | F.col("error").isNotNull())
    return read.select(id_col, "error", F.inline_outer("packets")).select(id_col, *(n for n, _ in _PACKET), "error")


def cue_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each cue: its time, track, and the byte position of the cluster; ``found`` tells whether one begins there."""
    read = read_media(media, id_col, media_col).select(id_col, "clusters", F.inline("cues"))
    return read.select(id_col, "time_ns", "track", "position", F.array_contains("clusters", F.col("position")).alias("found"))


def stored_digest(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, n_bytes, sizes, hashes and feature) of stored files (id, n_bytes, media): payloads are read by the packets' byte ranges."""
    kind = media.schema[id_col].dataType.simpleString()
    read = read_media(media, id_col, media_col, (id_col, "n_bytes", media_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, media_col):
            rows = []
            cols = [column_of(piece, c) for c in ("packets", "cues", "clusters")]
            count = [np.diff(np.asarray(c.offsets)) for c in cols]
            flat = cols[0].flatten()
            track, time, offset, size = (np.asarray(flat.field(k)) for k in range(4))
            ends = np.cumsum(count[0])
            for i, data in enumerate(bytes_of(piece, media_col)):
                own = range(ends[i] - count[0][i], ends[i])
                payload = b"".join([data[offset[j] : offset[j] + size[j]] for j in own if track[j] == 1])
                if not payload:
                    raise ValueError("a stored file has no packets")
                what = feature(column_of(piece, "tracks")[i].as_py(), int(count[2][i]), int(count[1][i]), len(own), int(time[own[-1]]), payload)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), what))
            total, sha, tail, media_bytes, media_sha, features = zip(*rows)
            out = record(payload_bytes=(total, pa.int64()), payload_sha256=(sha, pa.string()), tail_crc32=(tail, pa.int64()), media_bytes=(media_bytes, pa.int64()), media_sha256=(media_sha, pa.string()), feature=(features, pa.string()))
            yield pa.RecordBatch.from_arrays([column_of(piece, id_col), column_of(piece, "n_bytes"), *out.columns], names=[id_col, "n_bytes", *out.schema.names])

    return read.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text in a table of the shared folder, read the stored files' packet tables, and describe both."""
    return stored_digest(checkpoint(encode_media(docs, id_col, text_col)), id_col)
