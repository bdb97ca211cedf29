"""MPEG audio as media columns: frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

parse() reads MPEG-1, 2 and 2.5 audio of layers I to III, free format too: it skips and parses
ID3v2, ID3v1 and APE tags, resynchronises on headers that the next header confirms, checks the CRC
of protected frames of all layers, reads Xing, Info and VBRI tables and the encoder's delay and
padding, and gives exact durations in samples and the byte offset of every frame. store() and restore() keep any payload losslessly in the ancillary data of valid,
silent Layer III frames, which every decoder skips.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, texts, tuned

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer), samples a second by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

#: Payload bytes in a frame, and the header of the frames that hold them: MPEG-1 Layer III, CRC, 224 kbit/s, 48 kHz, mono.
UNIT = 576
HEADER = bytes([0xFF, 0xFA, 0xC4, 0xC0])
FRAME = 672
SIDE = 17
PAYLOAD_AT = 4 + 2 + SIDE
FILLER = 255


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    bitrate: int  # kbit/s
    rate: int
    mono: bool
    samples: int
    length: int
    stream: int  # bits that all frames of a stream share
    joint: int = -1  # where joint stereo begins, in fours of subbands less one; -1: nowhere

    @property
    def side(self) -> int:
        """Bytes of side information in Layer III."""
        return {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}[self.version == 3, self.mono]


def header_at(data: bytes, at: int) -> Header | None:
    """The frame header at a position; None if there is none. A frame of free format has bitrate 0 and, until free_length() finds it, length 0."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer, rate = b1 >> 3 & 3, 4 - (b1 >> 1 & 3), b2 >> 2 & 3
    if version == 1 or layer == 4 or rate == 3 or b2 >> 4 == 15 or b3 & 3 == 2:
        return None
    kbit, hertz, pad = BITRATES[version == 3, layer][b2 >> 4], RATES[version][rate], b2 >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = 0 if not kbit else (12000 * kbit // hertz + pad) * 4 if layer == 1 else samples * 125 * kbit // hertz + pad
    return Header(version, layer, not b1 & 1, kbit, hertz, b3 >> 6 == 3, samples, length, (b1 & 0xFE) << 8 | b2 & 0x0C, b3 >> 4 & 3 if b3 >> 6 == 1 else -1)


def free_length(data: bytes, at: int, end: int, h: Header) -> int:
    """The length of a frame of free format: up to the next header like it, or to the end."""
    nxt = at + 4
    while 0 <= (nxt := data.find(b"\xff", nxt, end)):
        g = header_at(data, nxt)
        if g is not None and g.stream == h.stream and not g.bitrate:
            return nxt - at
        nxt += 1
    return end - at


def _layer2_bits(h: Header) -> tuple[int, ...]:
    """Bits of allocation of each subband in Layer II. Fixed values of the standards: runs of (subbands, bits)."""
    each = h.bitrate // (1 if h.mono else 2)
    if h.version != 3:
        runs = ((4, 4), (7, 3), (19, 2))
    elif h.bitrate and each <= 48:
        runs = ((2, 4), (10, 3)) if h.rate == 32000 else ((2, 4), (6, 3))
    elif h.rate == 48000 or (h.bitrate and each <= 80):
        runs = ((11, 4), (12, 3), (4, 2))
    else:
        runs = ((11, 4), (12, 3), (7, 2))
    return tuple(b for n, b in runs for _ in range(n))


def protected_bits(h: Header, body: bytes) -> int:
    """How many bits after header and checksum the checksum covers; body begins with them."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    widths = (4,) * 32 if h.layer == 1 else _layer2_bits(h)
    bound = len(widths) if h.joint < 0 else min(len(widths), 4 * (h.joint + 1))
    bits = sum(widths[:bound]) * channels + sum(widths[bound:])
    if h.layer == 1:
        return bits
    value, at, chosen = int.from_bytes(body[: bits // 8 + 1].ljust(bits // 8 + 1, b"\0"), "big"), 8 * (bits // 8 + 1), 0
    for n, width in enumerate(widths):  # two more bits for each channel of a subband that is used
        for _ in range(channels if n < bound else 1):
            at -= width
            chosen += (value >> at & (1 << width) - 1 > 0) * (1 if n < bound else channels)
    return bits + 2 * chosen


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        r = i << 8
        for _ in range(8):
            r = (r << 1 ^ 0x8005 if r & 0x8000 else r << 1) & 0xFFFF
        table.append(r)
    return table


def crc16(data: bytes, table=_crc_table()) -> int:
    r = 0xFFFF
    for x in data:
        r = (r << 8 & 0xFF00) ^ table[r >> 8 ^ x]
    return r


def checksum(head: bytes, body: bytes, bits: int) -> int:
    """Of the last two bytes of a header and the first bits of what follows its checksum."""
    r = crc16(head[2:4] + body[: bits // 8])
    for i in range(bits // 8 * 8, bits):
        bit = body[i // 8] >> 7 - i % 8 & 1 if i // 8 < len(body) else 0
        r = (r << 1 & 0xFFFF) ^ (0x8005 if (r >> 15) ^ bit else 0)
    return r


@dataclass
class Audio:
    offsets: np.ndarray  # of audio frames; a table frame is none
    lengths: np.ndarray
    samples: int = 0
    rate: int = 0
    crc_right: int = 0
    crc_wrong: int = 0
    skipped: int = 0  # bytes that belong to no frame or tag
    resyncs: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    kinds: set = field(default_factory=set)

    @property
    def seconds(self) -> float:
        """Without what the encoder says that it put before and after."""
        gap = sum((self.table or {}).get(k, 0) for k in ("delay", "padding"))
        return max(0, self.samples - gap) / self.rate if self.rate else 0.0


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, tags: dict) -> int:
    """Bytes of the ID3v2 tag at the start of data; its text frames go to tags."""
    if data[:3] != b"ID3" or len(data) < 10 or any(x & 0x80 for x in data[6:10]):
        return 0
    major, size = data[3], 10 + _synchsafe(data[6:10])
    end, at, name = min(size, len(data)), 10, 3 if major == 2 else 4
    while at + name + (3 if major == 2 else 6) <= end and data[at] != 0:
        key = data[at : at + name].decode("latin-1")
        if major == 2:
            n, head = int.from_bytes(data[at + 3 : at + 6], "big"), 6
        else:
            raw = data[at + 4 : at + 8]
            n, head = _synchsafe(raw) if major == 4 else int.from_bytes(raw, "big"), 10
        body = data[at + head : min(at + head + n, end)]
        if key[0] == "T" and body:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            tags[key] = body[1:].decode(coding, "replace").rstrip("\0")
        at += head + n
    return size + (10 if data[5] & 0x10 else 0)


def _tail(data: bytes, tags: dict) -> int:
    """Where tags at the end of data begin."""
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags[f"v1:{key}"] = value
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I", data[end - 20 : end - 16])[0], struct.unpack("<I", data[end - 12 : end - 8])[0]
        tags["ape"] = str(size)
        end = max(0, end - size - (32 if flags & 0x80000000 else 0))
    return end


def _table(data: bytes, at: int, h: Header) -> dict | None:
    """The Xing, Info or VBRI table in a frame."""
    if h.layer != 3:
        return None
    x = at + 4 + 2 * h.protected + h.side
    if (kind := data[x : x + 4]) in (b"Xing", b"Info"):
        flags, x, out = struct.unpack(">I", data[x + 4 : x + 8])[0], x + 8, {"kind": kind.decode()}
        for bit, key, n in ((1, "frames", 4), (2, "bytes", 4), (4, "seek", 100), (8, "quality", 4)):
            if flags & bit and x + n <= len(data):
                out[key] = tuple(data[x : x + n]) if n == 100 else struct.unpack(">I", data[x : x + 4])[0]
                x += n
        if x + 24 <= len(data) and data[x : x + 4] in (b"LAME", b"Lavc", b"Lavf", b"GOGO"):
            both = int.from_bytes(data[x + 21 : x + 24], "big")
            out |= {"encoder": data[x : x + 9].decode("latin-1").rstrip("\0 "), "delay": both >> 12, "padding": both & 0xFFF}
        return out
    x = at + 36
    if data[x : x + 4] == b"VBRI" and x + 26 <= len(data):
        size, frames, entries, scale, width = *struct.unpack(">II", data[x + 10 : x + 18]), *struct.unpack(">HHH", data[x + 18 : x + 24])
        seek = tuple(int.from_bytes(data[x + 26 + i * width : x + 26 + (i + 1) * width], "big") * scale for i in range(entries)) if width else ()
        return {"kind": "VBRI", "bytes": size, "frames": frames, "seek": seek}
    return None


def parse(data: bytes) -> Audio:
    """All frames of an MPEG audio file; bytes between frames are skipped and counted."""
    tags: dict[str, str] = {}
    at = start = min(len(data), _id3v2(data, tags))
    end = max(at, _tail(data, tags))
    out = Audio(np.zeros(0, np.int64), np.zeros(0, np.int64), tags=tags)
    offsets: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    stream, lost, first = None, False, True
    checked: dict[bytes, int] = {}
    array = np.frombuffer(data, np.uint8)
    while at < end:
        h = header_at(data, at)
        if h is not None and not h.bitrate:
            h = replace(h, length=free_length(data, at, end, h))
        sound = h is not None and at + h.length <= end and (stream is None or h.stream == stream)
        if sound and (stream is None or lost):  # a header found by search counts only if the next place confirms it
            following = header_at(data, at + h.length) if at + h.length < end else h
            sound = following is not None and following.stream == h.stream
        if not sound:
            if not lost and (stream is not None or at > start):
                out.resyncs += 1
            lost = True
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        stream, lost = h.stream, False
        if first:
            first = False
            out.rate = h.rate
            if (table := _table(data, at, h)) is not None:
                out.table = table
                at += h.length
                continue
        n = 1
        if h.length >= 4:  # frames with the same header follow each other: take the whole run at once
            most = (end - at) // h.length
            same = (array[at : at + most * h.length].reshape(most, h.length)[:, :4] == array[at : at + 4]).all(axis=1)
            n = most if same.all() else int(same.argmin())
        if h.protected:
            reads = 6 + (h.side if h.layer == 3 else min(h.length - 6, 32 if h.layer == 1 else 48))
            rows = array[at : at + n * h.length].reshape(n, h.length)[:, :reads]
            for raw, count in zip(*np.unique(rows, axis=0, return_counts=True)) if n < 64 or (rows != rows[0]).any() else [(rows[0], n)]:
                key = raw.tobytes()
                if key not in checked:
                    checked[key] = checksum(key, key[6:], protected_bits(h, key[6:])) == key[4] << 8 | key[5]
                right = checked[key]
                out.crc_right += int(count) * right
                out.crc_wrong += int(count) * (not right)
        offsets.append(at + h.length * np.arange(n))
        lengths.append(np.full(n, h.length))
        out.samples += n * h.samples
        out.kinds.add((h.version, h.layer, h.bitrate))
        at += n * h.length
    if offsets:
        out.offsets, out.lengths = np.concatenate(offsets), np.concatenate(lengths)
    return out


def padded(text: str) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, filled up to a positive multiple of UNIT, and their number before."""
    raw = text.encode()
    return raw + bytes([FILLER]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def _frames(payload: bytes) -> np.ndarray:
    side = bytes(SIDE)  # no main data: silence; what follows is ancillary
    head = HEADER + struct.pack(">H", crc16(HEADER[2:] + side)) + side
    out = np.zeros((len(payload) // UNIT, FRAME), np.uint8)
    out[:, :PAYLOAD_AT] = np.frombuffer(head, np.uint8)
    out[:, PAYLOAD_AT : PAYLOAD_AT + UNIT] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    return out


def store(payload: bytes) -> bytes:
    """A file of silent frames that hold payload, a positive multiple of UNIT bytes: an ID3v2 tag with the duration, an Info table, the frames."""
    frames = _frames(payload)
    n = len(frames)
    duration = b"\3" + str(n * 1152 * 1000 // 48000).encode()
    body = b"TLEN" + len(duration).to_bytes(4, "big") + b"\0\0" + duration
    tag = b"ID3\4\0\0" + bytes(len(body) >> s & 0x7F for s in (21, 14, 7, 0)) + body
    side = bytes(SIDE)
    seek = bytes(min(255, i * 256 // 100) for i in range(100))
    table = HEADER + struct.pack(">H", crc16(HEADER[2:] + side)) + side + b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + seek
    return tag + table.ljust(FRAME, b"\0") + frames.tobytes()


def restore(data: bytes, audio: Audio | None = None) -> bytes:
    """The payload that store() kept, read from the frames that parse() finds."""
    audio = audio or parse(data)
    array = np.frombuffer(data, np.uint8)
    first = int(audio.offsets[0]) if len(audio.offsets) else 0
    n = len(audio.offsets)
    if n and int(audio.offsets[-1]) == first + (n - 1) * FRAME:
        return array[first : first + n * FRAME].reshape(n, FRAME)[:, PAYLOAD_AT : PAYLOAD_AT + UNIT].tobytes()
    return b"".join(data[o + PAYLOAD_AT : o + PAYLOAD_AT + UNIT] for o in audio.offsets.tolist())


def describe(audio: Audio) -> str:
    """frames, samples, rate, right and wrong checksums, resynchronisations, skipped bytes, the table's frames, a digest of the seek offsets."""
    seek = zlib.crc32(audio.offsets.astype("<i8").tobytes())
    return (
        f"frames={len(audio.offsets)};samples={audio.samples};rate={audio.rate};crc={audio.crc_right}/{audio.crc_wrong};"
        f"resyncs={audio.resyncs};skipped={audio.skipped};table={(audio.table or {}).get('frames', 0)};ms={audio.tags.get('TLEN', '')};seek={seek:08x}"
    )


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64())]
    + [("media_sha256", pa.string()), ("feature", pa.string()), ("frames", pa.int64()), ("duration_s", pa.float64()), ("first_offset", pa.int64()), ("last_offset", pa.int64()), ("seek_offsets", pa.list_(pa.int64()))]
)


def _store(batches):
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            kept = [padded(t) for t in texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in kept], pa.int64()), pa.array([store(p) for p, _ in kept], pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches):
    for b in batches:
        rows = []
        for doc, n, data in zip(*(c.to_pylist() for c in b.columns)):
            data = data or b""
            audio = parse(data)
            payload = restore(data, audio)
            rows.append(
                (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), describe(audio))
                + (len(audio.offsets), audio.seconds, *map(int, audio.offsets[[0, -1]] if len(audio.offsets) else (-1, -1)), audio.offsets)
            )
        if rows:
            yield batch(_OUT, *zip(*rows))


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (an MPEG audio file that holds the whole text) for docs (doc_id, text); null counts as empty, and an empty text is one frame of filler."""
    tuned(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """What parse() finds in a media column (doc_id, n_bytes, media), and digests of the payload read back. Equal texts give equal values; an empty table gives an empty result."""
    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double", pa.list_(pa.int64()): "array<long>"}
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_features, ", ".join(f"{f.name} {kinds[f.type]}" for f in _OUT))
