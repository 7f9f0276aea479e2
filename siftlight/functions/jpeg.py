"""Baseline JPEG in numpy: whole images, all blocks of an image at once; bits are the only thing that is walked through.

``decode`` takes sequential 8-bit images, grey or YCbCr, with any sampling; others (progressive, arithmetic, damaged ones)
give None. ``encode`` writes JFIF with colour at full resolution and Huffman tables made for the image.
"""

from __future__ import annotations

import functools
import heapq
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np

#: The example quantisation tables of the JPEG standard (luminance, chrominance), which quality scales.
LUMINANCE = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99]])
CHROMINANCE = np.full((8, 8), 99)
CHROMINANCE[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]
#: Order of coefficients: along the anti-diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
#: An orthonormal cosine transform of eight values.
COSINE = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
TURN = COSINE.astype(np.float32)
#: Pixels of an image that is decoded at most: some 40 bytes are held for each.
MOST_PIXELS = 1 << 25
#: Bits that are put together before they become bytes.
CHUNK = 1 << 20


def tables(quality: float) -> tuple[np.ndarray, np.ndarray]:
    """Quantisation tables for a quality from 0 to 1: steps shrink from 1/2 on and are all 1 at 1."""
    percent = min(100, max(1, round(100 * quality)))
    scale = 5000 // percent if percent < 50 else 200 - 2 * percent
    return tuple(np.clip((t * scale + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE))


def _blocks(plane: np.ndarray) -> np.ndarray:
    """An image plane as rows of 8 x 8 blocks, its edges repeated to full blocks."""
    h, w = plane.shape
    plane = np.pad(plane, ((0, -h % 8), (0, -w % 8)), "edge")
    return plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)


def _lengths(counts: Counter) -> list[tuple[int, int]]:
    """(bits, symbol) of a Huffman code of at most 16 bits that leaves the code of ones unused."""
    weight = {s: n * 2 for s, n in counts.items()} | {-1: 1}  # -1 gets the last of the longest codes
    while True:
        heap = [(n, s == -1, [s]) for s, n in weight.items()]
        heapq.heapify(heap)
        bits = Counter()
        tie = 2
        while len(heap) > 1:
            (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            bits.update(a + b)
            heapq.heappush(heap, (n + m, tie, a + b))
            tie += 1
        longest = max(bits.values(), default=1)
        if longest <= 16:
            break
        weight = {s: n // 2 + 1 for s, n in weight.items()}
    bits[-1] = longest
    return sorted((bits[s] or 1, s == -1, s) for s in weight)


def _codes(lengths: list) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The table as it is stored, and (code, bits) of every symbol."""
    codes, code, before, counts = {}, 0, 0, [0] * 17
    for n, last, s in lengths:
        code <<= n - before
        before = n
        if not last:
            codes[s] = (code, n)
            counts[n] += 1
        code += 1
    return bytes(counts[1:]) + bytes(s for _, last, s in lengths if not last), codes


def _symbols(block: list[int], before: int, last: int) -> list[tuple[int, int, int, int]]:
    """(table, symbol, value, bits) of a block's coefficients in zigzag order; ``last``: where the last that is not 0 stands, 0 for none behind the first."""
    def amplitude(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return (v if v >= 0 else v + (1 << n) - 1), n

    v, n = amplitude(block[0] - before)
    out, zeros = [(0, n, v, n)], 0
    for c in block[1:last + 1]:
        if not c:
            zeros += 1
            continue
        out += [(1, 0xF0, 0, 0)] * (zeros // 16)
        v, n = amplitude(c)
        out.append((1, zeros % 16 << 4 | n, v, n))
        zeros = 0
    return out + [(1, 0, 0, 0)] * (last < 63)


def _walked(grids: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
    """The symbols of an image whose components have as many blocks each, a row of blocks at a time."""
    before = [0] * len(grids)
    for row in zip(*grids, strict=True):
        ordered = [r.reshape(-1, 64)[:, ZIGZAG] for r in row]
        lasts = [((z != 0) * np.arange(64)).max(1).tolist() for z in ordered]
        for at in zip(*[zip(z.tolist(), last, strict=True) for z, last in zip(ordered, lasts, strict=True)], strict=True):
            for k, (block, last) in enumerate(at):
                for t, s, v, n in _symbols(block, before[k], last):
                    yield 2 * (k > 0) + t, s, v, n
                before[k] = block[0]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(pixels: np.ndarray, quality: float) -> bytes:
    """An image (height x width x 3, or height x width if grey; 8 bits) as JPEG."""
    grey = pixels.ndim == 2
    x = pixels.astype(np.float64)
    planes = [x] if grey else [x @ [0.299, 0.587, 0.114], x @ [-0.168735892, -0.331264108, 0.5] + 128, x @ [0.5, -0.418687589, -0.081312411] + 128]
    steps = tables(quality)
    grids = [np.rint(COSINE @ (_blocks(p) - 128) @ COSINE.T / steps[k > 0]).astype(np.int16) for k, p in enumerate(planes)]
    counts = [Counter() for _ in range(2 if grey else 4)]
    symbols = (lambda: _walked(grids)) if pixels.size > CHUNK else list(_walked(grids)).__iter__  # a small image is walked through once
    for t, s, _, _ in symbols():
        counts[t][s] += 1
    stored, codes = zip(*[_codes(_lengths(c)) for c in counts], strict=True)
    data, held, size = [], [], 0
    for t, s, v, n in symbols():
        code, length = codes[t][s]
        held.append(f"{code:0{length}b}{v:0{n}b}" if n else f"{code:0{length}b}")
        size += length + n
        if size >= CHUNK:
            bits = "".join(held)
            whole = size // 8 * 8
            data.append(int(bits[:whole], 2).to_bytes(whole // 8, "big"))
            held, size = [bits[whole:]], size - whole
    bits = "".join(held) + "1" * (-size % 8)
    data = b"".join([*data, int(bits or "0", 2).to_bytes(len(bits) // 8, "big")]).replace(b"\xff", b"\xff\0")
    h, w = pixels.shape[:2]
    n = len(planes)
    return b"".join([
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), *[_segment(0xDB, bytes([k]) + bytes(steps[k].ravel()[ZIGZAG].tolist())) for k in range(min(n, 2))],
        _segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([k + 1, 0x11, k > 0]) for k in range(n))), *[_segment(0xC4, bytes([(k % 2) << 4 | k // 2]) + t) for k, t in enumerate(stored)],
        _segment(0xDA, bytes([n]) + b"".join(bytes([k + 1, (k > 0) * 0x11]) for k in range(n)) + b"\0\x3f\0"), data, b"\xff\xd9"])


class _Bits:
    """Entropy-coded bytes as a stream of bits."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def _fill(self) -> None:
        chunk = self.data[self.at:self.at + 8]
        self.at += 8
        self.held = (self.held & (1 << self.n) - 1) << 64 | int.from_bytes(chunk.ljust(8, b"\xff"), "big")  # ones behind the end
        self.n += 64
        if self.at > len(self.data) + 64:
            raise ValueError("the data ends in a block")

    def symbol(self, table: tuple[int, list[int], list[int]]) -> int:
        most, length, value = table
        if self.n < most:
            self._fill()
        k = self.held >> self.n - most & (1 << most) - 1
        if not length[k]:
            raise ValueError("no such code")
        self.n -= length[k]
        return value[k]

    def amplitude(self, n: int) -> int:
        if not n:
            return 0
        if self.n < n:
            self._fill()
        self.n -= n
        v = self.held >> self.n & (1 << n) - 1
        return v if v >> n - 1 else v - (1 << n) + 1


@functools.lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> tuple[int, list[int], list[int]]:
    """Bits of the longest code; length and symbol for all runs of as many bits, which a shorter code is followed by."""
    most = max((n for n in range(1, 17) if counts[n - 1]), default=1)
    length, value, code, k = np.zeros(1 << most, int), np.zeros(1 << most, int), 0, 0
    for n in range(1, most + 1):
        for _ in range(counts[n - 1]):
            at = slice(code << most - n, code + 1 << most - n)
            length[at], value[at] = n, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return most, length.tolist(), value.tolist()


def _scan(data: bytes, order: list, per_restart: int, n_units: int) -> dict[int, np.ndarray]:
    """Coefficients of each component (zigzag order); ``order``: component, its tables, and its blocks in a unit."""
    out = {c: np.zeros((n_units * times, 64), np.int16) for c, _, _, times in order}
    filled = dict.fromkeys(out, 0)
    pieces = [data]
    if per_restart:
        pieces, at = [], 0
        for k in range(len(data) - 1):
            if data[k] == 0xFF and 0xD0 <= data[k + 1] <= 0xD7:
                pieces.append(data[at:k])
                at = k + 2
        pieces.append(data[at:])
    left = n_units
    for piece in pieces:
        bits, before = _Bits(piece.replace(b"\xff\0", b"\xff")), dict.fromkeys(out, 0)
        for _ in range(min(left, per_restart or left)):
            for c, dc, ac, times in order:
                for _ in range(times):
                    block = [0] * 64
                    before[c] += bits.amplitude(bits.symbol(dc))
                    block[0], k = before[c], 1
                    while k < 64:
                        s = bits.symbol(ac)
                        if not s & 15:
                            if s != 0xF0:
                                break
                            k += 16
                            continue
                        k += s >> 4
                        block[k] = bits.amplitude(s & 15)
                        k += 1
                    out[c][filled[c]] = block
                    filled[c] += 1
        left -= per_restart or left
    if left > 0:
        raise ValueError("blocks are missing")
    return out


def decode(data: bytes) -> np.ndarray | None:
    """Height x width x 3 pixels, or None for what is no whole baseline image."""
    try:
        return _decoded(data)
    except (ValueError, KeyError, IndexError, OverflowError, struct.error):
        return None


def _decoded(data: bytes) -> np.ndarray:
    at, steps, huffman, restart, frame = 2, {}, {}, 0, None
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if data[at] != 0xFF:
            raise ValueError("no marker")
        body, at = data[at + 4:at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                table = np.frombuffer(body[1:65 + 64 * wide], ">u2" if wide else "u1").astype(np.float32)
                steps[body[0] & 15] = table
                body = body[65 + 64 * wide:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = _lookup(body[1:17], body[17:17 + n])
                body = body[17 + n:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            bits, h, w, n = struct.unpack_from(">BHHB", body)
            frame = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if bits != 8 or n not in (1, 3) or not 0 < h * w <= MOST_PIXELS:
                raise ValueError("not a frame that is read here")
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xD0)) or marker == 0xD9:
            raise ValueError("not baseline")
        elif marker == 0xDA:
            break
    if frame is None or body[0] != len(frame):
        raise ValueError("components apart")
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
    coded = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    across, down = max(f[1] for f in frame), max(f[2] for f in frame)
    units_x, units_y = -(-w // (8 * across)), -(-h // (8 * down))
    order = [(c, huffman[coded[c] >> 4], huffman[0x10 | coded[c] & 15], fx * fy) for c, fx, fy, _ in frame]
    end = data.rfind(b"\xff\xd9")
    found = _scan(data[at:end if end >= at else len(data)], order, restart, units_x * units_y)
    planes = []
    for c, fx, fy, q in frame:
        z = found.pop(c) * steps[q]
        coefficients = np.empty_like(z)
        coefficients[:, ZIGZAG] = z
        b = TURN.T @ coefficients.reshape(-1, 8, 8) @ TURN + np.float32(128)
        plane = b.reshape(units_y, units_x, fy, fx, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(units_y * fy * 8, units_x * fx * 8)
        planes.append(plane.repeat(down // fy, 0).repeat(across // fx, 1)[:h, :w])
    if len(planes) == 1:
        rgb = np.stack(planes * 3, 2)
    else:
        f = np.float32
        y, cb, cr = planes[0], planes[1] - f(128), planes[2] - f(128)
        rgb = np.stack([y + f(1.402) * cr, y - f(0.344136286) * cb - f(0.714136286) * cr, y + f(1.772) * cb], 2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def shrunk(pixels: np.ndarray, most: int) -> np.ndarray:
    """Means of the cells of a grid whose longer side is ``most``; a smaller image stays as it is."""
    h, w = pixels.shape[:2]
    side = max(h, w)
    if side <= most:
        return pixels
    rows, cols = np.arange(h) * most // side, np.arange(w) * most // side
    first_row, first_col = np.flatnonzero(np.diff(rows, prepend=-1)), np.flatnonzero(np.diff(cols, prepend=-1))
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), first_row, 0), first_col, 1)
    cells = np.diff(np.append(first_row, h))[:, None] * np.diff(np.append(first_col, w))
    return (sums // cells[..., None]).astype(np.uint8)
