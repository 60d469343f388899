"""Motion-JPEG in AVI: a media column that holds bytes without loss, and timed clips read from such columns.

A payload is cut into frames of 16 x 12 samples.  A frame is a baseline grey JPEG of 128 x 96 pixels in which
every sample is one flat 8 x 8 block: with a quantiser of 8 for the DC coefficient each pixel of the block
decodes to exactly the sample, so any JPEG decoder gives the payload back.  The Huffman code for the
DC difference of s bits is 9 - s bits long, and the end-of-block code 7, so a block is two bytes.

The reader walks the RIFF index, decodes each intra frame (baseline, grey or in colours of any sampling, with its own
Huffman tables or, as most motion-JPEG has none, the standard's; codes of a constant length by array operations, others
by table look-up), and cuts shots where the histogram of a frame differs from the one before by more than an adaptive
threshold.

Null payloads are stored as empty ones; every payload is followed by bytes 32 up to a positive multiple of
192, one frame's samples.  Equal payloads give equal media.  A payload of more than half a gigabyte does not fit into
a value of a column and fails.  Media that are null, cut off or broken give no row less: `error` says what is wrong, frames before the
place where a file is cut off still count, and a file without an index is read chunk by chunk.  Empty tables give
empty ones, repeated rows equal results; columns with the results' names are replaced, all others kept.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import map_arrow, materialize
from graphmill.llm.wordhash import text_bytes

COLUMNS, LINES = 16, 12
FRAME = COLUMNS * LINES
FPS = 25
PAD = b" "
#: Frames to either side that an adaptive threshold looks at, its factor on their spread, and its least value.
NEAR, SPREAD, LEAST = 8, 2.0, 0.35
#: Payload bytes that are encoded or decoded at once.
PORTION = 256 << 10
#: Bytes of a row group of stored media, so that neither writer nor reader holds many of them.
ROW_GROUP = 1 << 20

# Fixed values of ISO/IEC 10918-1: the order in which coefficients are stored.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
# Fixed values of ISO/IEC 10918-1, annex K: number of codes of each length, and the symbols in their order.
_LUMA_DC = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
_CHROMA_DC = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
_LUMA_AC_FIRST = [
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32,
    0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82,
]
_CHROMA_AC_FIRST = [
    0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14,
    0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1,
]
#: All symbols of AC codes: a run of up to 15 zeros and a size of 1 to 10, end of block, and 16 zeros.  Those with codes of 16 bits follow in ascending order.
_AC_ALL = sorted([0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))])
_LUMA_AC = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], _LUMA_AC_FIRST + [s for s in _AC_ALL if s not in _LUMA_AC_FIRST])
_CHROMA_AC = ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], _CHROMA_AC_FIRST + [s for s in _AC_ALL if s not in _CHROMA_AC_FIRST])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _canonical(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) to symbol, as a DHT segment defines it."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


_DC_COUNTS, _DC_SYMBOLS = [1] * 9 + [0] * 7, list(range(8, -1, -1))
_AC_COUNTS, _AC_SYMBOLS = [0] * 6 + [1] + [0] * 9, [0]
HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + bytes([8] + [1] * 63))
    + _segment(0xC0, struct.pack(">BHHB3B", 8, LINES * 8, COLUMNS * 8, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + bytes(_DC_COUNTS) + bytes(_DC_SYMBOLS))
    + _segment(0xC4, b"\x10" + bytes(_AC_COUNTS) + bytes(_AC_SYMBOLS))
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)
TAIL = b"\xff\xd9"


def _block_words() -> np.ndarray:
    """The two bytes of a block for each DC difference from -255 to 255."""
    code = {s: (length, c) for (length, c), s in _canonical(_DC_COUNTS, _DC_SYMBOLS).items()}
    out = np.zeros(511, ">u2")
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        bits = diff if diff >= 0 else diff + (1 << size) - 1
        out[diff + 255] = ((code[size][1] << size) | bits) << 7
    return out


_WORDS = _block_words()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of frames x FRAME samples."""
    level = samples.astype(np.int16)
    diff = np.diff(level, axis=1, prepend=np.int16(128))
    raw = _WORDS[diff + 255].tobytes()
    step = 2 * FRAME
    return [HEAD + raw[a : a + step].replace(b"\xff", b"\xff\x00") + TAIL for a in range(0, len(raw), step)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames: list[bytes], width: int = COLUMNS * 8, height: int = LINES * 8, fps: int = FPS) -> bytes:
    """An AVI file of one motion-JPEG stream with its index."""
    n, largest = len(frames), max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    parts, index, at = [b"movi"], [], 4
    for f in frames:
        even = len(f) + len(f) % 2
        parts.append(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (even - len(f)))
        index.append((b"00dc", 0x10, at, len(f)))
        at += 8 + even
    entries = np.array(index, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", entries.tobytes()))


def store(payload: bytes) -> bytes:
    """The media that hold a payload whose length is a positive multiple of FRAME."""
    return avi(encode_frames(np.frombuffer(payload, np.uint8).reshape(-1, FRAME)))


def padded(text: bytes) -> bytes:
    return text + PAD * (-len(text) % FRAME or (0 if text else FRAME))


class Broken(ValueError):
    """Media that are no AVI of motion-JPEG frames."""


_ENTRY = np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
_IS_FRAME = re.compile(rb"[0-9]{2}d[bc]")


def riff_index(media: bytes) -> tuple[list[bytes], float, str | None]:
    """The frames that the index lists, frames a second, and what is wrong, if anything."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise Broken("no AVI file")
    movi, entries, fps, wrong = None, None, float(FPS), None
    open_ = [(12, min(len(media), 8 + int.from_bytes(media[4:8], "little")))]
    if open_[0][1] < 8 + int.from_bytes(media[4:8], "little"):
        wrong = "cut off"
    while open_:
        at, end = open_.pop()
        if at + 8 > end:
            continue
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        open_.append((at + 8 + size + size % 2, end))
        body, stop = at + 8, min(end, at + 8 + size)
        if name == b"LIST" and media[body : body + 4] == b"movi":
            movi = movi or (body, stop)
        elif name == b"LIST":
            open_.append((body + 4, stop))
        elif name == b"avih" and stop - body >= 4:
            fps = 1e6 / (int.from_bytes(media[body : body + 4], "little") or 1e6 / FPS)
        elif name == b"idx1":
            entries = np.frombuffer(media[body : body + (stop - body) // 16 * 16], _ENTRY)
    if movi is None:
        raise Broken("no frames")
    if entries is None:
        wanted, wrong = _one_by_one(media, *movi), wrong or "no index"
    else:
        listed = [(i, a, n) for i, a, n in zip(entries["id"].tolist(), entries["at"].tolist(), entries["size"].tolist(), strict=True) if _IS_FRAME.fullmatch(i)]
        listed = [x for x in listed if x[0][:2] == listed[0][0][:2]]  # the first stream of pictures
        # Offsets count from the list's name, or in some files from the start of the file.
        base = 0 if listed and media[listed[0][1] : listed[0][1] + 4] == listed[0][0] else movi[0]
        wanted = [(base + a + 8, n) for _, a, n in listed]
    frames: list[bytes] = []
    for at, n in wanted:
        if at + n > len(media):
            wrong = "cut off"
            break
        # A frame of no bytes shows the one before again.
        if n or frames:
            frames.append(media[at : at + n] if n else frames[-1])
    return frames, fps, wrong


def _one_by_one(media: bytes, at: int, end: int) -> list[tuple[int, int]]:
    """Places and sizes of the whole frames of a list without an index."""
    out, at = [], at + 4
    while at + 8 <= end:
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"LIST":
            at += 12
            continue
        if _IS_FRAME.fullmatch(name) and at + 8 + size <= end:
            out.append((at + 8, size))
        at += 8 + size + size % 2
    return out


def _lookup(codes: dict[tuple[int, int], int]) -> list[int]:
    """For the next 16 bits: the length of the code they begin with, times 256, and its symbol; 0 where there is none."""
    out = [0] * (1 << 16)
    for (length, code), symbol in codes.items():
        low = code << (16 - length)
        out[low : low + (1 << (16 - length))] = [length << 8 | symbol] * (1 << (16 - length))
    return out


class Scan:
    """What the segments before a frame's entropy-coded data say."""

    def __init__(self, head: bytes) -> None:
        self.quantisers, self.restart, at = {}, 0, 2
        self.codes = {key: _canonical(*t) for key, t in ((0x00, _LUMA_DC), (0x01, _CHROMA_DC), (0x10, _LUMA_AC), (0x11, _CHROMA_AC))}
        self._tables: dict[int, list[int]] = {}
        while at + 4 <= len(head):
            marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
            body = head[at + 4 : at + 2 + size]
            if marker == 0xDB:
                while body:
                    wide = 64 * (1 + (body[0] >> 4))
                    q = np.frombuffer(body[1 : 1 + wide], np.uint8 if wide == 64 else ">u2").astype(np.int64)
                    self.quantisers[body[0] & 15], body = q, body[1 + wide :]
            elif marker == 0xC0:
                self.height, self.width, n = struct.unpack(">HHB", body[1:6])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if n == 1:
                    self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]  # one component is never interleaved
                if not self.height or not self.width or not n or any(not 1 <= x <= 4 for p in self.parts for x in p[1:3]):
                    raise Broken("no picture")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise Broken("no baseline frame")
            elif marker == 0xC4:
                while body:
                    counts = list(body[1:17])
                    n = sum(counts)
                    self.codes[body[0]], body = _canonical(counts, list(body[17 : 17 + n])), body[17 + n :]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                self.tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                if len(self.tables) != len(self.parts):
                    raise Broken("several scans")
            at += 2 + size
        #: Blocks of the picture's luma, and of the interleaved units, across and down.
        self.across, self.down = -(-self.width // 8), -(-self.height // 8)
        widest, tallest = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if (self.parts[0][1], self.parts[0][2]) != (widest, tallest):
            raise Broken("colours finer than luma")
        self.units = (-(-self.width // (8 * widest)), -(-self.height // (8 * tallest)))
        self.fixed = self._fixed()

    def lookup(self, key: int) -> list[int]:
        if key not in self._tables:
            self._tables[key] = _lookup(self.codes[key])
        return self._tables[key]

    def _fixed(self) -> np.ndarray | None:
        """DC differences by the 16 bits of a block, if every block has 16 bits and no AC coefficient."""
        if len(self.parts) != 1 or self.restart:
            return None
        t = self.tables[self.parts[0][0]]
        dc, ac = self.codes[t >> 4], self.codes[0x10 | t & 15]
        end = [length for (length, c), s in ac.items() if s == 0 and c == 0]
        if len(ac) != 1 or len(end) != 1 or {length + s for (length, _), s in dc.items()} != {16 - end[0]}:
            return None
        out = np.zeros(1 << 16, np.int16)
        for (_, code), size in dc.items():
            for bits in range(1 << size):
                value = bits if not size or bits >> (size - 1) else bits - (1 << size) + 1
                out[((code << size) | bits) << end[0]] = value
        return out


#: Interleaved units that are decoded at once.
STRIP = 4096


def _coefficients(scan: Scan, data: bytes, units: int) -> Iterator[np.ndarray]:
    """Quantised luma coefficients (blocks in the order of storage x 64) of so many interleaved units, by strips."""
    plan = []
    for c, (name, h, v, _) in enumerate(scan.parts):
        t = scan.tables[name]
        plan += [(c, scan.lookup(t >> 4), scan.lookup(0x10 | t & 15))] * (h * v)
    own = scan.parts[0][1] * scan.parts[0][2]
    last = [0] * len(scan.parts)
    held, n, at, size = 0, 0, 0, len(data)
    for first in range(0, units, STRIP):
        here = min(STRIP, units - first)
        out, block = np.zeros((here * own, 64), np.int16), 0
        for _ in range(here):
            for c, dc, ac in plan:
                k, table = 0, dc
                while k < 64:
                    while n < 32:
                        held = (held << 32 | int.from_bytes(data[at : at + 4].ljust(4, b"\xff"), "big")) & 0xFFFFFFFFFFFFFFFF
                        at, n = at + 4, n + 32
                    entry = table[held >> (n - 16) & 0xFFFF]
                    if not entry:
                        raise Broken("no such code")
                    n -= entry >> 8
                    symbol = entry & 0xFF
                    bits = symbol & 15
                    value = held >> (n - bits) & ((1 << bits) - 1)
                    n -= bits
                    if bits and not value >> (bits - 1):
                        value -= (1 << bits) - 1
                    if not k:
                        last[c] += value
                        value, table = last[c], ac
                    elif not bits:
                        if symbol != 0xF0:
                            break
                        k += 16
                        continue
                    else:
                        k += symbol >> 4
                    if not c:
                        out[block, k] = value
                    k += 1
                block += not c
            if at - n // 8 > size:
                raise Broken("a frame is cut off")
        yield out


_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])
_SCANS: dict[bytes, Scan] = {}


def _scan_of(head: bytes) -> Scan:
    if head not in _SCANS:
        if len(_SCANS) > 64:
            _SCANS.clear()
        _SCANS[head] = Scan(head)
    return _SCANS[head]


def _head(frame: bytes) -> int:
    """Where a frame's entropy-coded data begin."""
    at = 2
    while at + 4 <= len(frame):
        size = int.from_bytes(frame[at + 2 : at + 4], "big")
        if frame[at] != 0xFF or size < 2:
            break
        at += 2 + size
        if frame[at - size - 1] == 0xDA:
            return at
    raise Broken("no scan")


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Mean luma of each 8 x 8 block (frames x blocks), as 8-bit samples."""
    if not frames:
        return np.zeros((0, 0), np.uint8)
    try:
        head = frames[0][: _head(frames[0])]
        scan = _scan_of(head)
        if scan.fixed is not None and all(f.startswith(head) for f in frames):
            n = len(head)
            raw = b"".join([f[n:-2].replace(b"\xff\x00", b"\xff") for f in frames])
            diff = scan.fixed[np.frombuffer(raw, ">u2")].reshape(len(frames), scan.across * scan.down)
            dc = np.cumsum(diff, axis=1, dtype=np.int16).astype(np.int32) * int(scan.quantisers[scan.parts[0][3]][0])
            return np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8)
        return np.stack([np.concatenate([p.mean(axis=(1, 2)).round().astype(np.uint8) for p in _strips(f)]) for f in frames])
    except Broken:
        raise
    except (KeyError, IndexError, ValueError, struct.error, AttributeError, OverflowError, MemoryError) as e:
        raise Broken(f"a frame is broken: {e}") from e


def pixels(frame: bytes) -> np.ndarray:
    """Luma of a baseline frame as blocks x 8 x 8 pixels, row by row, decoded in full."""
    return np.concatenate(list(_strips(frame)))


def _strips(frame: bytes) -> Iterator[np.ndarray]:
    """Luma of a baseline frame by strips of whole rows of units, each blocks x 8 x 8 pixels.

    A picture larger than its bytes can hold is refused before anything is decoded: a block takes two bits or more.
    """
    n = _head(frame)
    scan = _scan_of(frame[:n])
    across, total = scan.units[0], scan.units[0] * scan.units[1]
    data, each = frame[n:-2] if frame.endswith(TAIL) else frame[n:], scan.restart or total
    if not total or total * sum(h * v for _, h, v, _ in scan.parts) > 4 * len(data):
        raise Broken("a frame is cut off")
    runs = re.split(rb"\xff[\xd0-\xd7]", data) if scan.restart else [data]
    if len(runs) < -(-total // each):
        raise Broken("a frame is cut off")
    _, h, v, q = scan.parts[0]
    whole = max(1, STRIP // across) * across * h * v
    held, size, left, todo = [], 0, scan.down, total * h * v
    for i, run in enumerate(runs[: -(-total // each)]):
        units = min(each, total - i * each)
        for part in _coefficients(scan, run.replace(b"\xff\x00", b"\xff"), units):
            held.append(part)
            size, todo = size + len(part), todo - len(part)
            while size >= whole or size and not todo:
                joined = np.concatenate(held)
                taken, rest = joined[:whole], joined[whole:]
                held, size = [rest], len(rest)
                # From units of h x v blocks to rows of blocks; what lies beyond the picture goes.
                rows = len(taken) // (across * h * v)
                grid = taken.reshape(rows, across, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(rows * v, across * h, 64)[: min(left, rows * v), : scan.across]
                left -= len(grid)
                plain = np.zeros((grid.shape[0] * grid.shape[1], 64))
                plain[:, ZIGZAG] = grid.reshape(-1, 64).astype(np.int64) * scan.quantisers[q]
                spatial = np.einsum("xu,buv,yv->bxy", _COS, plain.reshape(-1, 8, 8), _COS)
                yield np.clip(np.rint(spatial) + 128, 0, 255)


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """First frame and frame after the last of each shot.

    A cut is where the histogram difference (half the sum over 16 bins, 0 to 1) exceeds both LEAST and the
    mean of its neighbours' differences by SPREAD of their standard deviations, and is the largest nearby.
    """
    n = len(samples)
    if n < 2:
        return [(0, n)] if n else []
    width = samples.shape[1]
    bins = np.bincount((np.arange(n)[:, None] * 16 + (samples >> 4)).ravel(), minlength=16 * n).reshape(n, 16)
    diff = np.abs(np.diff(bins, axis=0)).sum(axis=1) / (2 * width)
    total, square = np.concatenate(([0], np.cumsum(diff))), np.concatenate(([0], np.cumsum(diff * diff)))
    low, high = np.maximum(np.arange(n - 1) - NEAR, 0), np.minimum(np.arange(n - 1) + NEAR + 1, n - 1)
    count = np.maximum(high - low - 1, 1)
    mean = (total[high] - total[low] - diff) / count
    spread = np.sqrt(np.maximum((square[high] - square[low] - diff * diff) / count - mean * mean, 0))
    around = np.concatenate(([0], diff, [0]))
    cuts = np.flatnonzero((diff > LEAST) & (diff > mean + SPREAD * spread) & (diff >= around[:-2]) & (diff > around[2:])) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _store_column(batches):
    for batch in batches:
        keys, payload = batch.column(0), text_bytes(batch.column(1))
        start = 0
        while start < len(payload):
            stop, size = start, 0
            while stop < len(payload) and (stop == start or size + len(payload[stop]) <= PORTION):
                size += len(payload[stop])
                stop += 1
            some = [padded(p) for p in payload[start:stop]]
            frames = encode_frames(np.frombuffer(b"".join(some), np.uint8).reshape(-1, FRAME))
            media, at = [], 0
            for p in some:
                n = len(p) // FRAME
                media.append(avi(frames[at : at + n]))
                at += n
            yield pa.RecordBatch.from_arrays(
                [keys.slice(start, stop - start), pa.array([len(p) for p in payload[start:stop]], pa.int64()), pa.array(media, pa.binary())],
                ["row", "n_bytes", "media"],
            )
            start = stop


def store_media(df: DataFrame, payload: str = "text") -> DataFrame:
    """df with n_bytes, the payload's length, and media, the AVI file that holds it; columns of these names are replaced."""
    own = df.drop("n_bytes", "media")
    packed = own.select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("row"), F.col(f"`{payload}`").cast("binary").alias("payload"))
    kind = packed.schema["row"].dataType.simpleString()
    return map_arrow(packed, _store_column, f"row {kind}, n_bytes long, media binary").select("row.*", "n_bytes", "media")


_READ = {
    "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "n_frames": "long", "fps": "double",
    "clips": "array<struct<clip:bigint,first_frame:bigint,end_frame:bigint,start_s:double,end_s:double,luma:double>>", "error": "string",
}


def read_one(media: bytes | None) -> tuple:
    """What _READ names, of one medium; digests are those of the samples that its frames decode to."""
    if media is None:
        return (None,) * 7 + ([], "no media")
    frames, fps, samples, wrong = [], float(FPS), np.zeros((0, 0), np.uint8), None
    try:
        frames, fps, wrong = riff_index(media)
        samples = decode_frames(frames)
    except Broken as e:
        frames, wrong = [], str(e)
    raw = samples.tobytes()
    cut = [
        {"clip": i, "first_frame": a, "end_frame": b, "start_s": a / fps, "end_s": b / fps, "luma": float(samples[a:b].mean())}
        for i, (a, b) in enumerate(shots(samples))
    ]
    return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), len(frames), fps, cut, wrong


def _read_column(batches):
    schema = pa.schema([(c, k) for c, k in zip(_READ, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), _CLIPS, pa.string()), strict=True)])
    for batch in batches:
        out = [read_one(m.as_py()) for m in batch.column(1)]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(_READ)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]], ["row", *_READ])


_CLIPS = pa.list_(pa.struct([("clip", pa.int64()), ("first_frame", pa.int64()), ("end_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("luma", pa.float64())]))


def read_media(stored: DataFrame, media: str = "media") -> DataFrame:
    """One row for each medium, with the other columns: digests of what its frames hold and of the file, timed clips, and what is wrong."""
    own = [c for c in stored.columns if c != media and c not in _READ]
    row = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("none"))
    packed = stored.select(row.alias("row"), F.col(f"`{media}`").cast("binary").alias("media"))
    schema = ", ".join([f"row {packed.schema['row'].dataType.simpleString()}", *(f"{c} {k}" for c, k in _READ.items())])
    return map_arrow(packed, _read_column, schema).select(*[F.col(f"row.`{c}`") for c in own], *_READ)


def clips(df: DataFrame, media: str = "media") -> DataFrame:
    """A row for each shot of each medium: its number, frames, times in seconds and mean luma, with df's other columns."""
    made = ["clip", "first_frame", "end_frame", "start_s", "end_s", "luma"]
    read = read_media(df.drop(*[c for c in made if c != media]), media).drop(*[c for c in _READ if c != "clips"])
    return read.select("*", F.explode("clips").alias("__clip")).select(*[F.col(f"`{c}`") for c in read.columns if c != "clips"], "__clip.*")


def media_round_trip(df: DataFrame, payload: str = "text") -> DataFrame:
    """Store each payload as a medium in a written table, read the table back: read_media() of it, n_bytes, and the clips in one string."""
    stored = materialize(store_media(df, payload).drop(payload), "media", **{"parquet.block.size": ROW_GROUP, "parquet.enable.dictionary": "false"})
    spans = F.transform("clips", lambda c: F.format_string("%.2f-%.2f", c["start_s"], c["end_s"]))
    feature = F.concat(F.lit("frames="), F.col("n_frames"), F.lit(";shots="), F.size("clips"), F.lit(";"), F.array_join(spans, ","))
    out = read_media(stored).withColumn("feature", feature)
    return out.drop("n_frames", "fps", "clips", "error")
