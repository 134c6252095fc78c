"""Matroska bytes: a parser for the parts that packet tables need, and a writer for 8-bit PCM.

The parser walks EBML elements (variable-length ids and sizes, sizes unknown included), clusters,
simple blocks and block groups, all four kinds of lacing, and cues. Offsets are absolute bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

# Element ids of the public Matroska specification.
EBML, DOCTYPE = 0x1A45DFA3, 0x4282
SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements of the segment's level: where one of these starts, a cluster of unknown size ends.
TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, 0x1043A770, 0x1254C367, 0x1941A469}


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    rate: float = 8000.0
    channels: int = 1
    bits: int = 0
    frame_ns: int = 0


@dataclass
class Media:
    doctype: str = "matroska"
    scale_ns: int = 1_000_000
    tracks: dict[int, Track] = field(default_factory=dict)
    #: (track, timestamp in ns, offset, size, keyframe, place in its lace, cluster)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    #: (time in ns, track, absolute offset of the cluster)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int]:
    """A variable-length integer and the place after it; -1 if all its bits are set (unknown size)."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > end:
        raise ValueError(f"a variable-length integer runs past byte {end}")
    value = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return value, at + length
    value &= (1 << 7 * length) - 1
    return (-1 if value == (1 << 7 * length) - 1 else value), at + length


def elements(data: bytes, at: int, end: int, unknown_ends: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int]]:
    """``(id, start, end)`` of the contents of each element between two places."""
    while at < end:
        kind, body = vint(data, at, end, keep_marker=True)
        length, body = vint(data, body, end)
        if length < 0:
            stop = _unknown_end(data, body, end, unknown_ends)
        else:
            stop = body + length
            if stop > end:
                raise ValueError(f"element {kind:#x} at byte {at} runs past byte {end}")
        yield kind, body, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int, unknown_ends: frozenset | set) -> int:
    while at < end:
        kind, body = vint(data, at, end, keep_marker=True)
        if kind in unknown_ends:
            return at
        length, body = vint(data, body, end)
        at = _unknown_end(data, body, end, TOP_LEVEL | {EBML, SEGMENT}) if length < 0 else body + length
    return end


def _uint(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _float(data: bytes, at: int, end: int) -> float:
    import struct

    return struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0] if end > at else 0.0


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block whose contents start at ``at``, and where the first begins."""
    if not lacing:
        return [end - at], at
    if at >= end:
        raise ValueError(f"a laced block ends at byte {at}")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise ValueError(f"{end - at} bytes are not {count} equal frames")
        return [(end - at) // count] * count, at
    if lacing == 1:
        for _ in range(count - 1):
            total = 0
            while True:
                if at >= end:
                    raise ValueError("lace sizes run past their block")
                total, at = total + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(total)
    else:
        for i in range(count - 1):
            start = at
            value, at = vint(data, at, end)
            if i:  # a difference, stored with half its range as bias
                value = ((1 << 7 * (at - start)) - 1 if value < 0 else value) - ((1 << 7 * (at - start) - 1) - 1) + sizes[-1]
            sizes.append(value)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("lace sizes exceed their block")
    return [*sizes, last], at


def parse(data: bytes) -> Media:
    """Raises ValueError where the bytes are not well-formed."""
    media = Media()
    for kind, at, end in elements(data, 0, len(data), {EBML, SEGMENT}):
        if kind == EBML:
            for k, a, e in elements(data, at, end):
                if k == DOCTYPE:
                    media.doctype = data[a:e].rstrip(b"\0").decode("ascii", "replace")
        elif kind == SEGMENT:
            _segment(data, at, end, media)
    return media


def _segment(data: bytes, base: int, stop: int, media: Media) -> None:
    clusters = 0
    for kind, at, end in elements(data, base, stop, TOP_LEVEL):
        if kind == INFO:
            for k, a, e in elements(data, at, end):
                if k == TIMESTAMP_SCALE:
                    media.scale_ns = _uint(data, a, e)
        elif kind == TRACKS:
            for k, a, e in elements(data, at, end):
                if k == TRACK_ENTRY:
                    track = _track(data, a, e)
                    media.tracks[track.number] = track
        elif kind == CLUSTER:
            _cluster(data, at, end, media, clusters)
            clusters += 1
        elif kind == CUES:
            for k, a, e in elements(data, at, end):
                if k == CUE_POINT:
                    _cue(data, a, e, media, base)


def _track(data: bytes, at: int, end: int) -> Track:
    track = Track()
    for k, a, e in elements(data, at, end):
        if k == TRACK_NUMBER:
            track.number = _uint(data, a, e)
        elif k == TRACK_TYPE:
            track.kind = _uint(data, a, e)
        elif k == CODEC_ID:
            track.codec = data[a:e].decode("ascii", "replace")
        elif k == DEFAULT_DURATION:
            track.frame_ns = _uint(data, a, e)
        elif k == AUDIO:
            for kk, aa, ee in elements(data, a, e):
                if kk == SAMPLING_FREQUENCY:
                    track.rate = _float(data, aa, ee)
                elif kk == CHANNELS:
                    track.channels = _uint(data, aa, ee)
                elif kk == BIT_DEPTH:
                    track.bits = _uint(data, aa, ee)
    return track


def _cluster(data: bytes, at: int, end: int, media: Media, cluster: int) -> None:
    time = 0
    for k, a, e in elements(data, at, end):
        if k == CLUSTER_TIMESTAMP:
            time = _uint(data, a, e)
        elif k == SIMPLE_BLOCK:
            _block(data, a, e, media, cluster, time, None)
        elif k == BLOCK_GROUP:
            parts = list(elements(data, a, e))
            key = all(kk != REFERENCE_BLOCK for kk, _, _ in parts)
            for kk, aa, ee in parts:
                if kk == BLOCK:
                    _block(data, aa, ee, media, cluster, time, key)


def _block(data: bytes, at: int, end: int, media: Media, cluster: int, time: int, key: bool | None) -> None:
    number, at = vint(data, at, end)
    if at + 3 > end:
        raise ValueError(f"the block header at byte {at} is cut short")
    ticks = time + int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
    step = media.tracks[number].frame_ns if number in media.tracks else 0
    for i, size in enumerate(sizes):
        media.packets.append((number, ticks * media.scale_ns + i * step, at, size, bool(flags & 0x80) if key is None else key, i, cluster))
        at += size


def _cue(data: bytes, at: int, end: int, media: Media, base: int) -> None:
    time, places = 0, []
    for k, a, e in elements(data, at, end):
        if k == CUE_TIME:
            time = _uint(data, a, e) * media.scale_ns
        elif k == CUE_TRACK_POSITIONS:
            track = place = 0
            for kk, aa, ee in elements(data, a, e):
                if kk == CUE_TRACK:
                    track = _uint(data, aa, ee)
                elif kk == CUE_CLUSTER_POSITION:
                    place = _uint(data, aa, ee) + base
            places.append((track, place))
    media.cues += [(time, *x) for x in places]


# -- writing ---------------------------------------------------------------------------------

SAMPLE_RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 32  # samples a frame, frames a block, blocks a cluster
FRAME_MS = FRAME * 1000 // SAMPLE_RATE


def size_vint(value: int, length: int = 0) -> bytes:
    length = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _signed_vint(value: int) -> bytes:
    length = next(n for n in range(1, 9) if abs(value) < (1 << 7 * n - 1) - 1)
    return size_vint(value + (1 << 7 * length - 1) - 1, length)


def laced(frames: list[bytes]) -> tuple[int, bytes]:
    """The lacing flag bits and the block's contents: fixed sizes if all are equal, else EBML lacing."""
    sizes = [len(x) for x in frames]
    if len(frames) == 1:
        return 0, frames[0]
    if len(set(sizes)) == 1:
        return 2, bytes([len(frames) - 1]) + b"".join(frames)
    table = size_vint(sizes[0]) + b"".join(_signed_vint(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    return 3, bytes([len(frames) - 1]) + table + b"".join(frames)


_HEADER = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOCTYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
_INFO = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"weftline") + element(WRITING_APP, b"weftline"))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME_MS * 1_000_000)
        + element(AUDIO, element(SAMPLING_FREQUENCY, bytes.fromhex("45fa0000")) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)),
    ),
)


def mux_pcm8(payload: bytes) -> bytes:
    """8-bit mono PCM at 8 kHz in laced simple blocks, with a cue for each cluster."""
    body, cues = [_INFO, _TRACKS], b""
    at, per_block, per_cluster = sum(map(len, body)), FRAME * LACED, FRAME * LACED * BLOCKS
    for first in range(0, max(len(payload), 1), per_cluster):
        time = first // FRAME * FRAME_MS
        blocks = [number(CLUSTER_TIMESTAMP, time)]
        for start in range(first, min(first + per_cluster, len(payload)), per_block):
            chunk = payload[start : min(start + per_block, first + per_cluster)]
            lacing, contents = laced([chunk[i : i + FRAME] for i in range(0, len(chunk), FRAME)])
            ticks = start // FRAME * FRAME_MS - time
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + ticks.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1]) + contents))
        cues += element(CUE_POINT, number(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at)))
        cluster = element(CLUSTER, b"".join(blocks))
        body.append(cluster)
        at += len(cluster)
    return _HEADER + element(SEGMENT, b"".join(body) + element(CUES, cues))


def read_pcm(data: bytes, media: Media, track: int = 1) -> bytes:
    """The track's bytes, packet by packet in order of time."""
    return b"".join(data[at : at + size] for _, at, size in sorted((t, at, size) for number, t, at, size, _, _, _ in media.packets if number == track))
