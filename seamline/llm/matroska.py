"""Media columns: Matroska files as binary values, their packets as tables.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become the samples of an 8-bit PCM
track at 8 kHz: frames of 64 samples (8 ms), laced by up to 256 to a block, blocks grouped in clusters of at
most 30.72 s, clusters listed in cues. Reading parses the variable-length EBML elements again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import stored
from .wordbytes import texts_of

# fixed values: element ids of the Matroska format
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
FLAG_LACING, DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x9C, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3

FRAME, RATE, LACE, BLOCKS = 64, 8000, 256, 15
FRAME_MS = FRAME * 1000 // RATE


def vint(n: int, width: int = 0) -> bytes:
    """``n`` as a variable-length size: the leading zero bits of the first byte tell the width."""
    w = width or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def read_vint(data, at: int) -> tuple[int, int]:
    """(value, position after it); an unknown size (all value bits 1) is -1."""
    first = data[at]
    if not first:
        raise ValueError("not a variable-length number")
    w = 9 - first.bit_length()
    n = int.from_bytes(data[at : at + w], "big") & (1 << 7 * w) - 1
    return (-1 if n == (1 << 7 * w) - 1 else n), at + w


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def elements(data, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the bodies of the elements in ``data[at:end]``."""
    while at < end:
        first = data[at]
        w = 9 - first.bit_length() if first else 9
        if w > 4:
            raise ValueError("not an element id")
        kind = int.from_bytes(data[at : at + w], "big")
        n, body = read_vint(data, at + w)
        stop = end if n < 0 else body + n
        if stop > end:
            raise ValueError("an element ends beyond its parent")
        yield kind, body, stop
        at = stop


def lace(frames: list[bytes], how: int) -> bytes:
    """The body of a laced block after its flags."""
    if how == NO_LACE:
        (only,) = frames
        return only
    head = bytes([len(frames) - 1])
    if how == XIPH:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif how == EBML_LACE:
        sizes = [len(f) for f in frames[:-1]]
        for k, n in enumerate(sizes):
            if k == 0:
                head += vint(n)
            else:
                d = n - sizes[k - 1]
                w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
                head += vint(d + (1 << 7 * w - 1) - 1, w)
    elif len({*map(len, frames)}) > 1:
        raise ValueError("frames of a fixed lace have one size")
    return head + b"".join(frames)


def unlace(data, at: int, end: int, how: int) -> list[tuple[int, int]]:
    """(start, size) of each frame of a block's body."""
    if how == NO_LACE:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if how == FIXED:
        size, rest = divmod(end - at, n)
        if rest:
            raise ValueError("a fixed lace of uneven length")
        return [(at + k * size, size) for k in range(n)]
    for k in range(n - 1):
        if how == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            before = at
            value, at = read_vint(data, at)
            size = value if k == 0 else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace longer than its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % FRAME or (0 if data else FRAME))


def mux(payload: bytes) -> bytes:
    """The Matroska file of a payload whose length is a positive multiple of 64. Equal payloads give equal files."""
    frames = len(payload) // FRAME
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(MAX_ID_LENGTH, 4) + number(MAX_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
    app = b"seamline"
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", frames * FRAME_MS)) + element(MUXING_APP, app) + element(WRITING_APP, app))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, zlib.crc32(payload) + 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    parts, cues = [info, element(TRACKS, element(TRACK_ENTRY, track))], []
    at = sum(map(len, parts))
    for c in range(0, frames, LACE * BLOCKS):
        body = [number(TIMESTAMP, c * FRAME_MS)]
        for b in range(c, min(frames, c + LACE * BLOCKS), LACE):
            n = min(LACE, frames - b, c + LACE * BLOCKS - b)
            how, count = (FIXED, bytes([n - 1])) if n > 1 else (NO_LACE, b"")
            body.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", (b - c) * FRAME_MS, 0x80 | how << 1) + count + payload[b * FRAME : (b + n) * FRAME]))
        parts.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, number(CUE_TIME, c * FRAME_MS) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def _whole(data, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


class Media:
    """A parsed file: ``tracks``, ``cues`` as (ms, track, cluster position), ``packets`` as rows of
    (cluster, track, ms, keyframe, start, size), start counted in the file."""

    def __init__(self, data: bytes):
        self.data, self.tracks, self.cues, self.packets, self.clusters = data, {}, [], [], []
        (kind, at, end), (segment, self.origin, stop) = list(elements(data, 0, len(data)))[:2]
        if kind != EBML or segment != SEGMENT:
            raise ValueError("not a Matroska file")
        self.doc_type = next(bytes(data[a:b]) for k, a, b in elements(data, at, end) if k == DOC_TYPE)
        for kind, at, end in elements(data, self.origin, stop):
            if kind == TRACKS:
                for k, a, b in elements(data, at, end):
                    if k == TRACK_ENTRY:
                        self._track(a, b)
            elif kind == CLUSTER:
                self.clusters.append(at)
                self.packets += self.cluster(at, end, len(self.clusters) - 1)
            elif kind == CUES:
                self._cues(at, end)

    def _track(self, at: int, end: int) -> None:
        x = {k: (a, b) for k, a, b in elements(self.data, at, end)}
        audio = {k: (a, b) for k, a, b in elements(self.data, *x[AUDIO])} if AUDIO in x else {}
        self.tracks[_whole(self.data, *x[TRACK_NUMBER])] = {
            "codec": bytes(self.data[slice(*x[CODEC_ID])]).decode(),
            "frame_ms": _whole(self.data, *x[DEFAULT_DURATION]) // 1_000_000 if DEFAULT_DURATION in x else 0,
            "rate": struct.unpack(">d", self.data[slice(*audio[SAMPLING_FREQUENCY])])[0] if SAMPLING_FREQUENCY in audio else None,
            "bits": _whole(self.data, *audio[BIT_DEPTH]) if BIT_DEPTH in audio else None,
        }

    def _cues(self, at: int, end: int) -> None:
        for k, a, b in elements(self.data, at, end):
            if k == CUE_POINT:
                point = {k2: (a2, b2) for k2, a2, b2 in elements(self.data, a, b)}
                place = {k2: _whole(self.data, a2, b2) for k2, a2, b2 in elements(self.data, *point[CUE_TRACK_POSITIONS])}
                self.cues.append((_whole(self.data, *point[CUE_TIME]), place[CUE_TRACK], place[CUE_CLUSTER_POSITION]))

    def cluster(self, at: int, end: int, index: int) -> list[tuple]:
        out, base = [], 0
        for k, a, b in elements(self.data, at, end):
            if k == TIMESTAMP:
                base = _whole(self.data, a, b)
            elif k == SIMPLE_BLOCK:
                out += self._block(a, b, base, index)
            elif k == BLOCK_GROUP:
                for k2, a2, b2 in elements(self.data, a, b):
                    if k2 == BLOCK:
                        out += self._block(a2, b2, base, index)
        return out

    def _block(self, at: int, end: int, base: int, index: int) -> list[tuple]:
        track, at = read_vint(self.data, at)
        offset, flags = struct.unpack(">hB", self.data[at : at + 3])
        step = self.tracks.get(track, {}).get("frame_ms", 0)
        return [(index, track, base + offset + k * step, bool(flags & 0x80), s, n) for k, (s, n) in enumerate(unlace(self.data, at + 3, end, flags >> 1 & 3))]

    def payload(self, track: int = 1) -> bytes:
        return b"".join([self.data[s : s + n] for _, t, _, _, s, n in self.packets if t == track])

    def seek(self, ms: int, track: int = 1) -> list[tuple]:
        """Packets of the last cluster that a cue names at or before ``ms``."""
        found = [p for t, n, p in self.cues if t <= ms and n == track]
        at = self.origin + found[-1]
        _, a, b = next(elements(self.data, at, len(self.data)))
        return self.cluster(a, b, len(found) - 1)


def features(payload: bytes) -> str:
    """Level features of unsigned 8-bit samples, from whole numbers alone."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    n = len(x)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    levels = np.bincount((x + 128) >> 5, minlength=8)
    return f"n={n};mean={int(x.sum()) / n:.6f};power={int((x * x).sum()) / n:.6f};peak={int(np.abs(x).max())};crossings={crossings};levels=" + ",".join(map(str, levels.tolist()))


def _muxed(batches):
    for b in batches:
        texts = texts_of(b)
        sizes = pa.array([len(t) if t else 0 for t in texts], pa.int64())
        yield pa.record_batch([b.column(0), sizes, pa.array([mux(padded(t or b"")) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's Matroska file; null text as empty."""
    return docs.select("doc_id", "text").mapInArrow(_muxed, "doc_id long, n_bytes long, media binary")


def _packets(batches):
    for b in batches:
        for row in b.to_pylist():
            m = Media(row["media"])
            p = pd.DataFrame(m.packets, columns=["cluster", "track", "ms", "keyframe", "start", "size"])
            p.insert(0, "packet", np.arange(len(p)))
            p.insert(0, "doc_id", pd.array([row["doc_id"]] * len(p), "Int64"))
            yield pa.RecordBatch.from_pandas(p, preserve_index=False)


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet of every file: its cluster, track, time, and byte range in the file."""
    return media.select("doc_id", "media").mapInArrow(_packets, "doc_id long, packet long, cluster long, track long, ms long, keyframe boolean, start long, size long")


def _digest(media: bytes) -> tuple:
    m = Media(media)
    payload = m.payload()
    last = m.seek(1 << 62)[-1]
    packets = len(m.packets), m.packets[-1][0] + 1, max(p[2] for p in m.packets)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(media[last[4] : last[4] + last[5]]), len(media), hashlib.sha256(media).hexdigest(), features(payload), *packets


_DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_clusters long, last_ms long"


def _digested(batches):
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    for b in batches:
        rows = list(map(_digest, b.column(2).to_pylist()))
        cols = [list(c) for c in zip(*rows)] or [[]] * len(names)
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _DIGEST.split(", ")]
        yield pa.record_batch([b.column(0), b.column(1), *map(pa.array, cols, kinds)], names=["doc_id", "n_bytes", *names])


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text as Matroska in a table, read the stored bytes back, and describe them.

    One row per row of ``docs``, repeated rows and null doc_ids included; the last columns count the packets and
    clusters of its file and give the last packet's time. A null or empty text is 64 zero samples; a text of any
    length is as many clusters as it takes. Columns besides doc_id and text are ignored; an empty table gives an
    empty one.
    """
    media = stored(to_media(docs), "media")
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digested, f"doc_id long, n_bytes long, {_DIGEST}")
