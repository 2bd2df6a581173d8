"""Lossless WebP (VP8L): a decoder for whole bitstreams and an encoder for byte payloads.

The decoder reads prefix codes (simple and normal, grouped by an entropy image if there is one),
literals, back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms. The encoder stores a payload as the green samples of
pictures WIDTH wide with a prefix code of its own for each, long repeats as back-references and a
palette where few values occur; the other channels are constant. Payloads of over TILE samples are
stored as several pictures, one file after another.

Pictures of a batch in which only green varies, with a single group of codes, are decoded side by
side, one symbol of each at a time; all others one by one.

Defined results: null text is empty; a payload has at least 64 bytes. Equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

WIDTH, TILE, MAX_CODE = 64, 16_384, 11
#: Shortest repeat that the encoder stores as a back-reference.
REPEAT = 32

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

_REVERSED = [np.array([int(f"{i:0{n}b}"[::-1], 2) if n else 0 for i in range(1 << n)]) for n in range(16)]


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in the order of their codes, and their code lengths."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    return used, lengths[used]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """symbol << 4 | length by the next bits, first bit lowest, and how many bits that are; a lone symbol takes none."""
    used, wide = canonical(lengths)
    if len(used) == 0:
        raise ValueError("a prefix code without symbols")
    if len(used) == 1:
        return np.array([int(used[0]) << 4]), 0
    bits = int(wide[-1])
    spans = 1 << (bits - wide.astype(np.int64))
    if spans.sum() != 1 << bits:
        raise ValueError("a prefix code that is not complete")
    return np.repeat(used.astype(np.int64) << 4 | wide, spans)[_REVERSED[bits]], bits


class Bits:
    """Reads bits from the lowest on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at
        self.value = int.from_bytes(data, "little") if len(data) < 4096 else None

    def peek(self, n: int) -> int:
        if self.value is not None:
            return self.value >> self.at & ((1 << n) - 1)
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        got = self.peek(n)
        self.at += n
        if self.at > len(self.data) * 8:
            raise ValueError("the picture ends too early")
        return got

    def symbol(self, table: tuple[np.ndarray, int]) -> int:
        got = int(table[0][self.peek(table[1])])
        self.read(got & 15)
        return got >> 4


def read_code(bits: Bits, size: int) -> tuple[np.ndarray, int]:
    lengths = np.zeros(size, np.uint8)
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return decode_table(lengths)
    own = np.zeros(19, np.uint8)
    for i in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[i]] = bits.read(3)
    table = decode_table(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = bits.symbol(table)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
            continue
        n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        if at + n > size:
            raise ValueError("code lengths run over the alphabet")
        lengths[at : at + n] = before if s == 16 else 0
        at += n
    return decode_table(lengths)


def _number(bits: Bits, symbol: int) -> int:
    """Lengths and distances: a symbol and more bits."""
    if symbol < 4:
        return symbol + 1
    more = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << more) + bits.read(more) + 1


class Picture:
    """What stands before the pixels: the size, the transforms and the codes."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
            raise ValueError("not a lossless WebP file")
        self.bits = bits = Bits(data, 21 * 8)
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("an unknown version")
        self.transforms: list[tuple] = []
        self.xsize = self.width
        while bits.read(1):
            kind = bits.read(2)
            if kind in (PREDICTOR, CROSS_COLOUR):
                block = bits.read(3) + 2
                self.transforms.append((kind, self.xsize, block, read_pixels(bits, -(-self.xsize >> block), -(-self.height >> block))))
            elif kind == SUBTRACT_GREEN:
                self.transforms.append((kind, self.xsize))
            else:
                n = bits.read(8) + 1
                delta = read_pixels(bits, n, 1).view(np.uint8).reshape(n, 4)
                pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.transforms.append((kind, self.xsize, pack, np.cumsum(delta, 0, dtype=np.uint8).view(np.uint32).ravel()))
                self.xsize = -(-self.xsize >> pack)
        self.cache, self.blocks, self.groups = read_codes(bits, self.xsize, self.height, True)

    def finish(self, pixels: np.ndarray) -> np.ndarray:
        """ARGB pixels, rows of columns, from what the codes gave."""
        for t in reversed(self.transforms):
            pixels = (_unpredict, _uncross, _add_green, _unpalette)[t[0]](pixels, self.height, *t[1:])
        return pixels.reshape(self.height, self.width)


def read_codes(bits: Bits, width: int, height: int, top: bool) -> tuple[int, tuple | None, list]:
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise ValueError("a colour cache that is too large")
    blocks, n = None, 1
    if top and bits.read(1):
        block = bits.read(3) + 2
        which = read_pixels(bits, -(-width >> block), -(-height >> block)) >> 8 & 0xFFFF
        blocks, n = (block, -(-width >> block), which), int(which.max()) + 1
    sizes = (256 + 24 + ((1 << cache) if cache else 0), 256, 256, 256, 40)
    return cache, blocks, [[read_code(bits, x) for x in sizes] for _ in range(n)]


def read_pixels(bits: Bits, width: int, height: int) -> np.ndarray:
    return pixels_of(bits, width, height, *read_codes(bits, width, height, False))


def pixels_of(bits: Bits, width: int, height: int, cache: int, blocks: tuple | None, groups: list) -> np.ndarray:
    """The entropy-coded pixels, one symbol after another."""
    n, at, out = width * height, 0, np.zeros(width * height, np.uint32)
    kept, group, filled = [0] * (1 << cache if cache else 0), groups[0], 0
    while at < n:
        if blocks:
            group = groups[int(blocks[2][(at // width >> blocks[0]) * blocks[1] + (at % width >> blocks[0])])]
        s = bits.symbol(group[0])
        if s < 256:
            red = bits.symbol(group[1])
            blue = bits.symbol(group[2])
            out[at] = bits.symbol(group[3]) << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = _number(bits, s - 256)
            back = _number(bits, bits.symbol(group[4]))
            if back > 120:
                back -= 120
            else:
                dx, dy = NEAR[back - 1]
                back = max(1, dx + dy * width)
            if back > at or at + length > n:
                raise ValueError("a back-reference that leaves the picture")
            for done in range(0, length, back):  # repeats of what stands before
                step = min(back, length - done)
                out[at + done : at + done + step] = out[at + done - back : at + done - back + step]
            at += length
        else:
            for p in out[filled:at].tolist():
                kept[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache)] = p
            filled = at
            out[at] = kept[s - 280]
            at += 1
    return out


def _sub(size: int, block: int) -> int:
    return -(-size >> block)


def _add_green(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    green = pixels >> 8 & 255
    return pixels & 0xFF00FF00 | ((pixels >> 16) + green & 255) << 16 | (pixels + green & 255)


def _unpalette(pixels: np.ndarray, height: int, width: int, pack: int, colours: np.ndarray) -> np.ndarray:
    index = (pixels >> 8 & 255).reshape(height, -1)
    if pack:
        bits = 8 >> pack
        shifts = np.arange(1 << pack, dtype=np.uint32) * bits
        index = (index[:, :, None] >> shifts & ((1 << bits) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(colours)] = colours
    return full[index].ravel()


def _uncross(pixels: np.ndarray, height: int, width: int, block: int, codes: np.ndarray) -> np.ndarray:
    codes = codes.reshape(-1, _sub(width, block)).repeat(1 << block, 0)[:height].repeat(1 << block, 1)[:, :width].ravel()
    signed = lambda x: x.astype(np.uint8).view(np.int8).astype(np.int32)
    green_red, green_blue, red_blue = signed(codes & 255), signed(codes >> 8 & 255), signed(codes >> 16 & 255)
    green = signed(pixels >> 8 & 255)
    red = (pixels >> 16 & 255).astype(np.int32) + (green_red * green >> 5) & 255
    blue = (pixels & 255).astype(np.int32) + (green_blue * green >> 5) + (red_blue * signed(red) >> 5) & 255
    return pixels & 0xFF00FF00 | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def _unpredict(pixels: np.ndarray, height: int, width: int, block: int, modes: np.ndarray) -> np.ndarray:
    rest = pixels.view(np.uint8).reshape(height, width, 4).astype(int).tolist()
    mode = (modes >> 8 & 15).reshape(-1, _sub(width, block)).tolist()
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]

    def select(left, top, corner):
        towards = sum(abs(t - c) for t, c in zip(top, corner, strict=True)) - sum(abs(a - c) for a, c in zip(left, corner, strict=True))
        return left if towards < 0 else top

    for y in range(height):
        row, above = rest[y], rest[y - 1] if y else None
        for x in range(width):
            if not y:
                p = row[x - 1] if x else [0, 0, 0, 255]
            elif not x:
                p = above[0]
            else:
                left, top, corner = row[x - 1], above[x], above[x - 1]
                right = above[x + 1] if x + 1 < width else row[0]
                m = mode[y >> block][x >> block]
                if m == 0 or m > 13:
                    p = [0, 0, 0, 255]
                elif m < 5:
                    p = (left, top, right, corner)[m - 1]
                elif m == 5:
                    p = half(half(left, right), top)
                elif m < 10:
                    p = half(*((left, corner), (left, top), (corner, top), (top, right))[m - 6])
                elif m == 10:
                    p = half(half(left, corner), half(top, right))
                elif m == 11:
                    p = select(left, top, corner)
                elif m == 12:
                    p = [clamp(a + b - c) for a, b, c in zip(left, top, corner, strict=True)]
                else:
                    p = [clamp(a + int((a - c) / 2)) for a, c in zip(half(left, top), corner, strict=True)]
            row[x] = [(a + b) & 255 for a, b in zip(row[x], p, strict=True)]
    return np.array(rest, np.uint8).reshape(-1).view(np.uint32)


def _side_by_side(files: list[bytes], pictures: list[Picture], lanes: list[int]) -> Iterator[tuple[int, np.ndarray | None]]:
    """The green samples of pictures in which only green varies; None for a picture that uses the colour cache."""
    if not lanes:
        return
    n = np.array([pictures[i].xsize * pictures[i].height for i in lanes])
    raw = np.frombuffer(b"".join(files[i] for i in lanes) + b"\0\0\0", np.uint8).astype(np.uint32)
    window = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    limit = len(window) * 8 - 1

    def joined(tables):
        return np.concatenate([t for t, _ in tables]), np.cumsum([0, *(len(t) for t, _ in tables[:-1])]), np.array([(1 << b) - 1 for _, b in tables], np.uint32)

    flat, base, mask = joined([pictures[i].groups[0][0] for i in lanes])
    far, far_base, far_mask = joined([pictures[i].groups[0][4] for i in lanes])
    bit = np.cumsum([0, *(len(files[i]) for i in lanes[:-1])]) * 8 + np.array([pictures[i].bits.at for i in lanes])
    offset = np.cumsum(n) - n
    to, end = offset.copy(), offset + n
    green, stopped, lane, copies = np.zeros(int(n.sum()), np.uint8), np.zeros(len(lanes), bool), np.arange(len(lanes)), []

    def peek(at):
        at = np.minimum(at, limit)
        return window[at >> 3] >> (at & 7).astype(np.uint32)

    def number(symbol, at):  # lengths and distances
        more = np.where(symbol < 4, 0, (symbol - 2) >> 1)
        value = (peek(at) & ((1 << more) - 1).astype(np.uint32)).astype(np.int64)
        return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << more) + value + 1), at + more

    while len(lane):
        got = flat[base + (peek(bit) & mask)]
        symbol = got >> 4
        bit = bit + (got & 15)
        green[to] = symbol  # a back-reference overwrites it later
        step = 1
        if symbol.max() > 255:
            step = np.ones(len(lane), np.int64)
            stopped[lane[symbol >= 280]] = True
            some = np.flatnonzero((symbol > 255) & (symbol < 280))
            length, at = number(symbol[some] - 256, bit[some])
            got = far[far_base[lane[some]] + (peek(at) & far_mask[lane[some]])]
            back, bit[some] = number(got >> 4, at + (got & 15))
            copies.append((lane[some], to[some], length, back))
            step[some] = length
        to = to + step
        going = (to < end) & ~stopped[lane] & (bit <= limit)
        if not going.all():
            stopped[lane[~going & ((to > end) | (bit > limit))]] = True  # damaged: the other way raises
            lane, base, mask, bit, to, end = (x[going] for x in (lane, base, mask, bit, to, end))
    if copies:
        where, to, length, back = (np.concatenate(x) for x in zip(*copies, strict=True))
        widths = np.array([pictures[i].xsize for i in lanes])[where]
        near = np.array(NEAR)
        close = near[np.minimum(back, 120) - 1]
        back = np.where(back > 120, back - 120, np.maximum(1, close[:, 0] + close[:, 1] * widths))
        stopped[where[to - back < offset[where]]] = True
        for k, t, m, b in zip(where.tolist(), to.tolist(), length.tolist(), back.tolist(), strict=True):
            if not stopped[k]:  # a lane's copies come in their order
                for done in range(0, m, b):
                    step = min(b, m - done)
                    green[t + done : t + done + step] = green[t + done - b : t + done - b + step]
    for k, i in enumerate(lanes):
        yield i, None if stopped[k] else green[offset[k] : offset[k] + n[k]]


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels of each file, rows of columns."""
    pictures, out = [Picture(x) for x in files], [None] * len(files)
    lanes, alone = [], []
    for i, p in enumerate(pictures):
        plain = not p.cache and not p.blocks and all(p.groups[0][k][1] == 0 for k in (1, 2, 3))
        (lanes if plain else alone).append(i)
    for some, green in _side_by_side(files, pictures, lanes):
        p = pictures[some]
        if green is None:
            alone.append(some)
            continue
        g = p.groups[0]
        rest = int(g[3][0][0] >> 4) << 24 | int(g[1][0][0] >> 4) << 16 | int(g[2][0][0] >> 4)
        out[some] = p.finish(green.astype(np.uint32) << 8 | np.uint32(rest))
    for i in alone:
        p = pictures[i]
        out[i] = p.finish(pixels_of(p.bits, p.xsize, p.height, p.cache, p.blocks, p.groups))
    return out


class Writer:
    """Collects (value, number of bits), first bit lowest."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits


def prefix_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths; too long ones are avoided by evening out the counts."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 3:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        n = len(used)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        up = [0] * (2 * n - 1)
        for k in range(n, 2 * n - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            heapq.heapreplace(heap, (a + b, k))
            up[i] = up[j] = k
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[up[k]] + 1
        if max(depth[:n]) <= most:
            lengths[used] = depth[:n]
            return lengths
        weights = [(w + 1) // 2 for w in weights]


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's code with its first bit lowest."""
    used, wide = canonical(lengths)
    out = np.zeros(len(lengths), np.int64)
    if len(used) < 2:
        return out
    bits = int(wide[-1])
    spans = 1 << (bits - wide.astype(np.int64))
    first = (np.cumsum(spans) - spans) >> (bits - wide)
    out[used] = [int(_REVERSED[w][f]) for w, f in zip(wide.tolist(), first.tolist(), strict=True)]
    return out


def write_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(x < 256 for x in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for x in used:
            w.put(x, 8)
        return
    w.put(0, 1)
    items, i, all_ = [], 0, lengths.tolist()
    while i < len(all_):
        j = i
        while j < len(all_) and all_[j] == 0 and j - i < 138:
            j += 1
        if j - i >= 11:
            items.append((18, j - i - 11, 7))
        elif j - i >= 3:
            items.append((17, j - i - 3, 3))
        else:
            j = i + 1
            items.append((all_[i], 0, 0))
        i = j
    own = prefix_lengths(np.bincount([x[0] for x in items], minlength=19), 7)
    if np.count_nonzero(own) == 1:
        own[0 if own[0] == 0 else 1] = 1
    order = [int(own[k]) for k in CODE_LENGTH_ORDER]
    n = max(4, max(k + 1 for k, x in enumerate(order) if x))
    w.put(n - 4, 4)
    for x in order[:n]:
        w.put(x, 3)
    w.put(0, 1)
    codes = codes_of(own)
    for s, more, bits in items:
        w.put(int(codes[s]), int(own[s]))
        w.put(more, bits)


def _constant(w: Writer, symbol: int) -> None:
    w.put(1, 1)
    w.put(0, 1)
    w.put(1, 1)
    w.put(symbol, 8)


def _split_number(n: int) -> tuple[int, int, int]:
    """The symbol, the value of the bits after it, and their number."""
    n -= 1
    if n < 4:
        return n, 0, 0
    top = n.bit_length() - 1
    return 2 * top + (n >> (top - 1) & 1), n & ((1 << (top - 1)) - 1), top - 1


def find_repeats(x: np.ndarray, least: int = REPEAT) -> list[tuple[int, int, int]]:
    """(start, length, distance) of repeats of at least ``least`` samples, from left to right."""
    n = len(x)
    if n < 2 * least:
        return []
    weights = np.cumprod(np.full(n, 0x9E3779B97F4A7C15 | 1, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * weights)])
    # comparable hashes of all windows: sums scaled to the weight of the last position
    key = (total[least:] - total[:-least]) * weights[::-1][: n - least + 1]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return []
    earlier = np.full(len(key), -1, np.int64)
    earlier[order[same + 1]] = order[same]
    out, at, starts = [], 0, np.flatnonzero(earlier >= 0)
    while True:
        i = int(np.searchsorted(starts, at))
        if i == len(starts):
            return out
        s, e = int(starts[i]), int(earlier[starts[i]])
        differ = np.flatnonzero(x[s:][: 4096] != x[e : e + n - s][: 4096])
        length = int(differ[0]) if len(differ) else min(4096, n - s)
        if length >= least:
            out.append((s, length, s - e))
            at = s + length
        else:  # equal hashes of different windows
            at = s + 1


def encode_one(x: np.ndarray) -> bytes:
    """One file for at most TILE samples, a multiple of WIDTH."""
    w, height, width = Writer(), len(x) // WIDTH, WIDTH
    w.put(WIDTH - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)  # no alpha, version 0
    values = np.unique(x)
    if len(values) <= 16:
        pack = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(values) - 1, 8)
        w.put(0, 1)
        delta = np.diff(values, prepend=0).astype(np.uint8)
        lengths = prefix_lengths(np.bincount(delta, minlength=280), MAX_CODE)
        write_code(w, lengths)
        _constant(w, 0)
        _constant(w, 0)
        two = np.zeros(256, np.uint8)  # alpha is 255 in the first colour, and stays
        two[[0, 255] if len(values) > 1 else [255]] = 1
        write_code(w, two)
        _constant(w, 0)
        codes = codes_of(lengths)
        for i, d in enumerate(delta.tolist()):
            w.put(int(codes[d]), int(lengths[d]) if np.count_nonzero(lengths) > 1 else 0)
            if len(values) > 1:
                w.put(int(i == 0), 1)
        bits = 8 >> pack
        index = np.searchsorted(values, x).reshape(height, -1, 1 << pack)
        x, width = (index << (np.arange(1 << pack) * bits)).sum(2).astype(np.uint8).ravel(), WIDTH >> pack
    w.put(0, 1)  # no more transforms
    w.put(0, 2)  # no cache, one group of codes
    repeats = find_repeats(x)
    literal = np.ones(len(x), bool)
    for s, n, _ in repeats:
        literal[s + 1 : s + n] = False
    symbols = x.astype(np.int64)
    far = np.zeros(40, np.int64)
    extra = {}
    for s, n, d in repeats:
        length, back = _split_number(n), _split_number(d + 120)
        symbols[s] = 256 + length[0]
        far[back[0]] += 1
        extra[s] = (length, back)
    lengths = prefix_lengths(np.bincount(symbols[literal], minlength=280), MAX_CODE)
    if np.count_nonzero(lengths) == 1 and np.flatnonzero(lengths)[0] > 255:
        lengths[0] = 1
    write_code(w, lengths)
    _constant(w, 0)
    _constant(w, 0)
    _constant(w, 255)
    far_lengths = prefix_lengths(far, MAX_CODE)
    write_code(w, far_lengths)
    codes, far_codes = codes_of(lengths), codes_of(far_lengths)
    one, far_one = np.count_nonzero(lengths) == 1, np.count_nonzero(far_lengths) == 1
    keep = np.flatnonzero(literal)
    value, wide = codes[symbols[keep]], np.zeros(len(keep), np.int64) if one else lengths[symbols[keep]].astype(np.int64)
    if extra:  # a symbol, the length's bits, the distance's symbol and bits, in one value of up to 11 + 13 + 11 + 14 bits
        place = np.searchsorted(keep, list(extra))
        for k, ((_, more, n), (sym, more2, n2)) in zip(place.tolist(), extra.values(), strict=True):
            at = int(wide[k])
            value[k] |= more << at
            at += n
            if not far_one:
                value[k] |= int(far_codes[sym]) << at
                at += int(far_lengths[sym])
            value[k] |= more2 << at
            wide[k] = at + n2
    start = w.n
    at = start + np.cumsum(wide) - wide
    total = start + int(wide.sum())
    out = np.zeros(total // 8 + 9, np.uint8)
    head = np.frombuffer(w.value.to_bytes(start // 8 + 1, "little"), np.uint8)
    out[: len(head)] = head
    shifted = value << (at & 7)
    for i in range(int(wide.max(initial=0)) // 8 + 2):
        out += np.bincount((at >> 3) + i, weights=shifted >> (8 * i) & 255, minlength=len(out))[: len(out)].astype(np.uint8)
    body = b"\x2f" + out[: -(-total // 8)].tobytes()
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def encode_payload(payload: bytes) -> bytes:
    x = np.frombuffer(payload, np.uint8)
    return b"".join(encode_one(x[i : i + TILE]) for i in range(0, len(x), TILE))


def split_files(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + n])
        at += n
    return out


def decode_payloads(media: list[bytes]) -> list[bytes]:
    files = [split_files(x) for x in media]
    pixels = iter(decode_many([y for x in files for y in x]))
    return [b"".join((next(pixels) >> 8 & 255).astype(np.uint8).tobytes() for _ in x) for x in files]


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 64 if data else 64)


def feature(samples: bytes, n_files: int) -> str:
    """Number of pictures, height, mean and variance of the samples, and the mean step along rows."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64).reshape(-1, WIDTH)
    n = x.size
    return f"{n_files}:{WIDTH}x{len(x)}:{int(x.sum()) / n:.4f}:{(int((x * x).sum()) * n - int(x.sum()) ** 2) / n / n:.4f}:{int(np.abs(np.diff(x, axis=1)).sum()) / n:.4f}"


def store(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, if with_media, media (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                media = [encode_payload(padded(x)) for x in texts]
                back = decode_payloads(media)
                sha = lambda all_: pa.array([hashlib.sha256(x).hexdigest() for x in all_], pa.string())
                number = lambda all_: pa.array(all_, pa.int64())
                cols = [part.column(0), number([len(x) for x in texts]), number([len(x) for x in back]), sha(back), number([zlib.crc32(x[-64:]) for x in back]), number([len(x) for x in media]), sha(media), pa.array([feature(x, len(split_files(m))) for x, m in zip(back, media, strict=True)], pa.string())]
                if with_media:
                    cols.append(pa.array(media, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * with_media]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return map_arrow(docs.select("doc_id", "text"), run, schema)
