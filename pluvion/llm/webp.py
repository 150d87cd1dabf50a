"""Lossless WebP (VP8L, RFC 9649): a decoder for all its parts, and an encoder.

Decoded: prefix codes (simple and normal, several groups by an entropy image), back-references with the map of near
distances, the colour cache, and the four transforms (predictor, cross-colour, subtract green, palette with packed
pixels), undone in reverse order. Pixels are ARGB in a (height, width) uint32 array.

Images whose red, blue and alpha take no bits (grey ones after subtract green, palettes) take a path where the symbol at
every bit is looked up at once; the chain of symbol starts is walked eight symbols a step.

The encoder of grey images chooses by size: a palette with packed pixels where there are 16 levels or fewer, a left or
top predictor where the residuals have the smaller entropy, and back-references to earlier passages of 32 samples or
more, found by sorting the hashes of all runs of eight.
"""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

MOST_SIDE = 1 << 14
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (columns left, rows up) of distance codes 1 to 120.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTHS, DISTANCES, LITERALS = 24, 40, 256
CACHE_FACTOR = 0x1E35A7BD


class BadImage(ValueError):
    pass


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data) * 8

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise BadImage("image data ends early")
        a = self.at
        word = int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little")
        self.at = a + n
        return (word >> (a & 7)) & ((1 << n) - 1)

    def peek15(self) -> int:
        a = self.at
        return (int.from_bytes(self.data[a >> 3 : (a >> 3) + 4], "little") >> (a & 7)) & 0x7FFF


_REVERSED = {n: np.array([int(f"{i:0{n}b}"[::-1], 2) if n else 0 for i in range(1 << n)]) for n in range(9)}


def _reverse(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The lowest n bits of each value in reverse order, n up to 16."""
    full = (_REVERSED[8][value & 255] << 8) | _REVERSED[8][value >> 8]
    return full >> (16 - n)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Bit-reversed canonical code of each symbol with a length."""
    used = np.flatnonzero(lengths)
    n = lengths[used]
    order = np.argsort(n, kind="stable")
    room = np.int64(1) << (15 - n[order])
    codes = np.zeros(len(lengths), np.int64)
    codes[used[order]] = (np.cumsum(room) - room) >> (15 - n[order])
    return _reverse(codes, lengths)


@functools.lru_cache(16)
def _turned(bits: int) -> np.ndarray:
    """Every number of so many bits, its bits in reverse order."""
    return _reverse(np.arange(1 << bits), np.full(1 << bits, bits))


class Code:
    """A prefix code as a table over ``bits`` next bits; a single symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.bits, self.symbol, self.length = 0, used[:1] if len(used) else np.zeros(1, np.int64), np.zeros(1, np.int64)
        else:
            n = lengths[used]
            self.bits = int(n.max())
            order = np.argsort(n, kind="stable")
            # a code of n bits fills every entry whose lowest n bits it is
            room = np.int64(1) << (self.bits - n[order])
            if int(room.sum()) != 1 << self.bits:
                raise BadImage("prefix code isn't complete")
            turn = _turned(self.bits)
            self.symbol, self.length = np.repeat(used[order], room)[turn], np.repeat(n[order], room)[turn]
        self.only = int(self.symbol[0]) if self.bits == 0 else None

    def lists(self):
        if not hasattr(self, "_lists"):
            self._lists = self.symbol.tolist(), self.length.tolist(), (1 << self.bits) - 1
        return self._lists

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        symbol, length, mask = self.lists()
        at = bits.peek15() & mask
        bits.at += length[at]
        return symbol[at]


@functools.lru_cache(256)
def _only(symbol: int) -> Code:
    lengths = np.zeros(symbol + 1, np.int64)
    lengths[symbol] = 1
    return Code(lengths)


def _read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if bits.take(1):
        two = bits.take(1)
        first = bits.take(8 if bits.take(1) else 1)
        if not two:
            return _only(first)
        lengths[first] = lengths[bits.take(8)] = 1
        return Code(lengths)
    first = np.zeros(19, np.int64)
    for i in range(4 + bits.take(4)):
        first[CODE_ORDER[i]] = bits.take(3)
    code = Code(first)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    i, before = 0, 8
    while i < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[i] = s
            i += 1
            before = s or before
        else:
            n = 3 + bits.take(2) if s == 16 else 3 + bits.take(3) if s == 17 else 11 + bits.take(7)
            if i + n > alphabet:
                raise BadImage("too many code lengths")
            if s == 16:
                lengths[i : i + n] = before
            i += n
    return Code(lengths)


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(x + y * width, 1)


def _read_group(bits: Bits, cache: int) -> list[Code]:
    return [_read_code(bits, n) for n in (LITERALS + LENGTHS + cache, LITERALS, LITERALS, LITERALS, DISTANCES)]


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = 0
    if bits.take(1):
        cache_bits = bits.take(4)
        if not 1 <= cache_bits <= 11:
            raise BadImage("colour cache of a wrong size")
    tile, groups_at, count = 0, None, 1
    if main and bits.take(1):
        tile = bits.take(3) + 2
        entropy = _read_pixels(bits, -(-width >> tile), -(-height >> tile), False)
        groups_at = (entropy >> 8) & 0xFFFF
        count = int(groups_at.max()) + 1
    groups = [_read_group(bits, 1 << cache_bits if cache_bits else 0) for _ in range(count)]
    if count == 1 and not cache_bits and all(c.only is not None for c in groups[0][1:4]):
        return _read_green(bits, width, height, groups[0])
    total = width * height
    out = np.zeros(total, np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    kept = 0
    at = 0
    tiles = groups_at.tolist() if groups_at is not None else None
    pixels: list[int] = []
    while at < total:
        group = groups[tiles[(at // width) >> tile][(at % width) >> tile]] if tiles else groups[0]
        s = group[0].read(bits)
        if s < LITERALS:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            pixels.append(alpha << 24 | red << 16 | s << 8 | blue)
            at += 1
        elif s < LITERALS + LENGTHS:
            length = _value(bits, s - LITERALS)
            distance = _distance(_value(bits, group[4].read(bits)), width)
            if distance > at or at + length > total:
                raise BadImage("reference outside the image")
            for i in range(at - distance, at - distance + length):
                pixels.append(pixels[i])
            at += length
        else:
            while kept < at:
                cache[(CACHE_FACTOR * pixels[kept] & 0xFFFFFFFF) >> shift] = pixels[kept]
                kept += 1
            pixels.append(cache[s - LITERALS - LENGTHS])
            at += 1
    out[:] = pixels
    if bits.at > bits.end:
        raise BadImage("image data ends early")
    return out.reshape(height, width)


def _read_green(bits: Bits, width: int, height: int, group: list[Code]) -> np.ndarray:
    """Pixels whose red, blue and alpha take no bits."""
    green, total = group[0], width * height
    rest = np.uint32(group[3].only << 24 | group[1].only << 16 | group[2].only)
    if green.only is not None and green.only < LITERALS:
        return np.full((height, width), rest | np.uint32(green.only << 8), np.uint32)
    start = bits.at >> 3
    raw = np.frombuffer(bits.data[start:] + b"\0\0\0\0", np.uint8).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16)
    span = (len(words) - 1) * 8
    windows = (words[:-1, None] >> np.arange(8, dtype=np.uint32)).ravel() & np.uint32((1 << green.bits) - 1)
    symbols = green.symbol.astype(np.int16)[windows]
    steps = np.where(green.symbol >= LITERALS, span, green.length).astype(np.int32)  # a reference leaves the walk
    one = np.empty(span + 1, np.int32)
    np.add(steps[windows], np.arange(span, dtype=np.int32), out=one[:-1])
    one[-1] = span
    np.minimum(one, span, out=one)
    two = one[one]
    four = two[two]
    eight = memoryview(four[four])
    out = np.empty(total, np.uint8)
    p, at = bits.at - start * 8, 0
    while at < total:
        walk = []
        keep = walk.append
        left = total - at
        while p < span and left > 0:
            keep(p)
            p = eight[p]
            left -= 8
        here = np.empty((len(walk), 8), np.int32)
        here[:, 0] = walk
        here[:, 4] = four[here[:, 0]]
        here[:, 2::4] = two[here[:, ::4]]
        here[:, 1::2] = one[here[:, ::2]]
        here = here.ravel()
        here = here[here < span]
        if not len(here):
            raise BadImage("image data ends early")
        got = symbols[here]
        ends = np.flatnonzero(got >= LITERALS)
        n = int(ends[0]) if len(ends) else len(got)
        n = min(n, total - at)
        out[at : at + n] = got[:n]
        at += n
        if at >= total:
            last = int(here[n - 1])
            bits.at = start * 8 + last + int(green.length[windows[last]])
            break
        if not len(ends):
            raise BadImage("image data ends early")
        mark = int(here[n])
        bits.at = start * 8 + mark + int(green.length[windows[mark]])
        length = _value(bits, int(got[n]) - LITERALS)
        distance = _distance(_value(bits, group[4].read(bits)), width)
        if distance > at or at + length > total:
            raise BadImage("reference outside the image")
        source = out[at - distance : min(at, at - distance + length)]
        out[at : at + length] = source if length <= distance else np.resize(source, length)
        at += length
        p = bits.at - start * 8
    return (out.astype(np.uint32) << np.uint32(8) | rest).reshape(height, width)


def _average(a, b):
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _split(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _pack(c) -> int:
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """Prediction from the neighbours to the left, above, above right and above left."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _average(_average(left, right), top)
        case 6:
            return _average(left, corner)
        case 7:
            return _average(left, top)
        case 8:
            return _average(corner, top)
        case 9:
            return _average(top, right)
        case 10:
            return _average(_average(left, corner), _average(top, right))
        case 11:
            a, b, c = _split(left), _split(top), _split(corner)
            by_left = sum(abs(y - z) for y, z in zip(b, c, strict=True))
            by_top = sum(abs(x - z) for x, z in zip(a, c, strict=True))
            return left if by_left < by_top else top
        case 12:
            return _pack([_clamp(x + y - z) for x, y, z in zip(_split(left), _split(top), _split(corner), strict=True)])
        case 13:
            mean = _split(_average(left, top))
            return _pack([_clamp(x + int((x - z) / 2)) for x, z in zip(mean, _split(corner), strict=True)])
    return 0xFF000000


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _subtract(a: int, b: int) -> int:
    return ((a | 0x00FF00FF) - (b & 0xFF00FF00) & 0xFF00FF00) | ((a | 0xFF00FF00) - (b & 0x00FF00FF) & 0x00FF00FF)


def _predict_alike(image: np.ndarray, top: bool, inverse: bool) -> np.ndarray:
    """Every pixel by the one to its left (first column: above), or above (first row: to its left)."""
    parts = np.ascontiguousarray(image, "<u4").view(np.uint8).reshape(*image.shape, 4).copy()
    if inverse:
        parts[0, 0] += np.array([0, 0, 0, 255], np.uint8)
        edge = parts[0] if top else parts[:, 0]
        edge[:] = np.cumsum(edge, axis=0, dtype=np.uint8)
        parts = np.cumsum(parts, axis=0 if top else 1, dtype=np.uint8)
    else:
        whole = parts.copy()
        parts[0, 0] -= np.array([0, 0, 0, 255], np.uint8)
        parts[0, 1:] -= whole[0, :-1]
        parts[1:, 0] -= whole[:-1, 0]
        if top:
            parts[1:, 1:] -= whole[:-1, 1:]
        else:
            parts[1:, 1:] -= whole[1:, :-1]
    return np.ascontiguousarray(parts).view("<u4").reshape(image.shape).astype(np.uint32)


def _predict(image: np.ndarray, modes: np.ndarray, tile: int, inverse: bool) -> np.ndarray:
    height, width = image.shape
    kinds = (modes >> 8) & 15
    if kinds.min() == kinds.max() and kinds[0, 0] in (1, 2):
        return _predict_alike(image, kinds[0, 0] == 2, inverse)
    flat = image.ravel().tolist()
    whole = flat[:] if not inverse else flat  # the inverse works on what it has restored
    mode = ((modes >> 8) & 15).tolist()
    out = [0] * len(flat)
    apply = _add if inverse else _subtract
    for i, value in enumerate(flat):
        y, x = divmod(i, width)
        if y == 0:
            p = 0xFF000000 if x == 0 else whole[i - 1]
        elif x == 0:
            p = whole[i - width]
        else:
            p = predicted(mode[y >> tile][x >> tile], whole[i - 1], whole[i - width], whole[i - width + 1], whole[i - width - 1])
        out[i] = apply(value, p)
        if inverse:
            whole[i] = out[i]
    return np.array(out, np.uint32).reshape(height, width)


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint8).view(np.int8).astype(np.int32)


def _cross_color(image: np.ndarray, elements: np.ndarray, tile: int, inverse: bool) -> np.ndarray:
    height, width = image.shape
    e = elements[np.arange(height)[:, None] >> tile, np.arange(width)[None, :] >> tile]
    delta = lambda t, c: (_signed(t & 255) * _signed(c & 255)) >> 5
    sign = 1 if inverse else -1
    green, red, blue = image >> 8, (image >> 16).astype(np.int32), image.astype(np.int64)
    new_red = (red + sign * delta(e, green)) & 255
    used = new_red if inverse else red & 255
    new_blue = (blue + sign * (delta(e >> 8, green) + delta(e >> 16, used))) & 255
    return (image & np.uint32(0xFF00FF00)) | (new_red.astype(np.uint32) << 16) | new_blue.astype(np.uint32)


def _green(image: np.ndarray, sign: int) -> np.ndarray:
    green = (image >> 8) & 255
    red, blue = (image >> 16) + np.uint32(sign % 2**32) * green, image + np.uint32(sign % 2**32) * green
    return (image & np.uint32(0xFF00FF00)) | (red & 255) << np.uint32(16) | blue & 255


def _cumulate(palette: np.ndarray) -> np.ndarray:
    return np.cumsum(palette.astype("<u4").view(np.uint8).reshape(-1, 4), axis=0).astype(np.uint8).ravel().view("<u4")


def _pack_bits(colors: int) -> int:
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


def decode_vp8l(data: bytes) -> np.ndarray:
    bits = Bits(data)
    if bits.take(8) != 0x2F:
        raise BadImage("no lossless image")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise BadImage("version isn't 0")
    steps, now, met = [], width, set()
    while bits.take(1):
        kind = bits.take(2)
        if kind in met:
            raise BadImage("transform occurs twice")
        met.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            tile = bits.take(3) + 2
            steps.append((kind, tile, _read_pixels(bits, -(-now >> tile), -(-height >> tile), False), now))
        elif kind == PALETTE:
            size = bits.take(8) + 1
            palette = _cumulate(_read_pixels(bits, size, 1, False)[0])
            steps.append((kind, _pack_bits(size), palette, now))
            now = -(-now >> _pack_bits(size))
        else:
            steps.append((kind, 0, None, now))
    image = _read_pixels(bits, now, height, True)
    for kind, tile, extra, wide in reversed(steps):
        if kind == PREDICTOR:
            image = _predict(image, extra, tile, True)
        elif kind == CROSS_COLOR:
            image = _cross_color(image, extra, tile, True)
        elif kind == SUBTRACT_GREEN:
            image = _green(image, 1)
        else:
            index = (image >> 8) & 255
            if tile:
                each = 8 >> tile
                index = ((index[:, :, None] >> (np.arange(1 << tile, dtype=np.uint32) * each)) & ((1 << each) - 1)).reshape(height, -1)[:, :wide]
            table = np.zeros(256, np.uint32)
            table[: len(extra)] = extra
            image = table[index]
    return image


def frames(data: bytes) -> list[bytes]:
    """VP8L streams of WebP files that stand one after the other."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise BadImage("no WebP file")
        end, at = at + 8 + struct.unpack_from("<I", data, at + 4)[0], at + 12
        if end > len(data):
            raise BadImage("file is cut off")
        while at + 8 <= end:
            kind, size = struct.unpack_from("<4sI", data, at)
            if kind == b"VP8L":
                out.append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
        at = end
    return out


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels (height, width) of a lossless WebP file."""
    (stream,) = frames(data)
    return decode_vp8l(stream)


# --- Encoder


class Writer:
    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def flush(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.int64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.flush()
        self.parts.append((values, sizes))

    def bytes(self) -> bytes:
        self.flush()
        values, sizes = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        total = int(sizes.sum())
        starts = np.cumsum(sizes) - sizes
        inside = np.arange(total, dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
        bits = (np.repeat(values.astype(np.int32), sizes) >> inside) & 1
        return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def huffman(counts: np.ndarray, most: int) -> np.ndarray:
    """Code lengths up to ``most``; counts are flattened until they fit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        up = [0] * (2 * len(weights) - 1)
        node = len(weights)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            up[i] = up[j] = node
            heapq.heapreplace(heap, (a + b, node))
            node += 1
        depth = [0] * node
        for i in range(node - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[: len(weights)]) <= most:
            lengths[used] = depth[: len(weights)]
            return lengths
        weights = [w // 2 + 1 for w in weights]


def _write_code(w: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) of each symbol after writing the code."""
    used = np.flatnonzero(counts).tolist()
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        wide = used[0] > 1
        w.put(int(wide), 1)
        w.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            w.put(used[1], 8)
            lengths[used] = 1
            return canonical(lengths), lengths
        return np.zeros(len(counts), np.int64), lengths
    lengths = huffman(counts, 12)
    if len(used) == 1:
        written = lengths
        lengths = np.zeros(len(counts), np.int64)
    else:
        written = lengths
    tokens: list[tuple[int, int, int]] = []
    values = written[: used[-1] + 1]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1])
    for v, n in zip(values[starts].tolist(), np.diff(np.append(starts, len(values))).tolist(), strict=True):
        if v == 0:
            while n >= 11:
                k = min(n, 138)
                tokens.append((18, k - 11, 7))
                n -= k
            if n >= 3:
                tokens.append((17, n - 3, 3))
                n = 0
        else:
            tokens.append((v, 0, 0))
            n -= 1
            while n >= 3:
                k = min(n, 6)
                tokens.append((16, k - 3, 2))
                n -= k
        tokens += [(v, 0, 0)] * n
    inner = huffman(np.bincount([t[0] for t in tokens], minlength=19), 7)
    code = canonical(inner)
    w.put(0, 1)
    last = max(i for i, s in enumerate(CODE_ORDER) if inner[s])
    w.put(max(last + 1, 4) - 4, 4)
    for s in CODE_ORDER[: max(last + 1, 4)]:
        w.put(int(inner[s]), 3)
    n = len(tokens)
    if n < len(counts):
        w.put(1, 1)
        n = max(n, 2)
        size = max((n - 2).bit_length(), 2)
        size += size & 1
        w.put((size - 2) // 2, 3)
        w.put(n - 2, size)
    else:
        w.put(0, 1)
    single = np.count_nonzero(inner) == 1
    for s, extra, bits in tokens:
        if not single:
            w.put(int(code[s]), int(inner[s]))
        if bits:
            w.put(extra, bits)
    if len(tokens) == 1 and not single:
        w.put(int(code[0]), int(inner[0]))
    return canonical(lengths) if lengths.any() else np.zeros(len(counts), np.int64), lengths


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix code, extra bits, their number) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _symbols(pixels: list[int], width: int, cache_bits: int, references: bool) -> list[tuple]:
    """("p", pixel), ("r", length, distance code) and ("c", index) that give the pixels."""
    out, last, i, total = [], {}, 0, len(pixels)
    cache: dict[int, int] = {}
    near = {max(x + y * width, 1): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    while i < total:
        length, distance = 0, 0
        if references:
            key = tuple(pixels[i : i + 3])
            j = last.get(key)
            if j is not None and len(key) == 3:
                while i + length < total and length < 4096 and pixels[j + length] == pixels[i + length]:
                    length += 1
                distance = i - j
        if length < 3:
            length = 0
        p = pixels[i]
        slot = (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if length:
            out.append(("r", length, near.get(distance, distance + len(NEAR))))
        elif cache_bits and cache.get(slot, 0) == p:
            out.append(("c", slot))
        else:
            out.append(("p", p))
        for k in range(i, i + max(length, 1)):
            if cache_bits:
                cache[(CACHE_FACTOR * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
            if references:
                last[tuple(pixels[k : k + 3])] = k
        i += max(length, 1)
    return out


def _write_pixels(w: Writer, image: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, tile: int = 0) -> None:
    height, width = image.shape
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups = np.zeros((1, 1), np.int64)
    if main:
        w.put(int(tile > 0), 1)
        if tile:
            w.put(tile - 2, 3)
            shape = -(-height >> tile), -(-width >> tile)
            groups = np.arange(shape[0] * shape[1]).reshape(shape) % 3
            _write_pixels(w, (groups << 8).astype(np.uint32), False)
    symbols = _symbols(image.ravel().tolist(), width, cache_bits, references)
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    count = int(groups.max()) + 1
    tables = [[np.zeros(n, np.int64) for n in sizes] for _ in range(count)]
    plan, at = [], 0
    for s in symbols:
        g = int(groups[(at // width) >> tile, (at % width) >> tile]) if tile else 0
        if s[0] == "p":
            a, r, green, b = _split(s[1])
            items = [(0, green, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
            at += 1
        elif s[0] == "c":
            items = [(0, LITERALS + LENGTHS + s[1], 0, 0)]
            at += 1
        else:
            (lp, le, ln), (dp, de, dn) = _prefix(s[1]), _prefix(s[2])
            items = [(0, LITERALS + lp, le, ln), (4, dp, de, dn)]
            at += s[1]
        for k, symbol, _, _ in items:
            tables[g][k][symbol] += 1
        plan.append((g, items))
    codes = [[_write_code(w, t) for t in group] for group in tables]
    for g, items in plan:
        for k, symbol, extra, n in items:
            code, length = codes[g][k]
            w.put(int(code[symbol]), int(length[symbol]))
            if n:
                w.put(extra, n)


def _riff(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def _header(w: Writer, width: int, height: int) -> None:
    if not (1 <= width <= MOST_SIDE and 1 <= height <= MOST_SIDE):
        raise BadImage("sides are 1 to 16384")
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)


def encode(image: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = True, tile: int = 0) -> bytes:
    """WebP file of ARGB pixels; transforms: (kind, argument) in the order in which they are applied.

    Arguments: predictor (bits of a tile, modes by tile), cross-colour (bits of a tile, elements by tile), none for
    subtract green and palette. Palettes come from the colours that the image has, up to 256.
    """
    image = np.ascontiguousarray(image, np.uint32)
    w = Writer()
    _header(w, image.shape[1], image.shape[0])
    for kind, argument in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOR):
            bits, extra = argument
            w.put(bits - 2, 3)
            stored = (np.asarray(extra, np.uint32) << 8) if kind == PREDICTOR else np.asarray(extra, np.uint32)
            _write_pixels(w, stored, False)
            image = _predict(image, stored, bits, False) if kind == PREDICTOR else _cross_color(image, stored, bits, False)
        elif kind == PALETTE:
            colors, index = np.unique(image, return_inverse=True)
            index = index.reshape(image.shape).astype(np.uint32)
            w.put(len(colors) - 1, 8)
            deltas = np.diff(colors.astype("<u4").view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
            _write_pixels(w, np.ascontiguousarray(deltas).view("<u4").reshape(1, -1), False)
            pack = _pack_bits(len(colors))
            if pack:
                each, wide = 8 >> pack, -(-image.shape[1] >> pack)
                padded = np.zeros((image.shape[0], wide << pack), np.uint32)
                padded[:, : image.shape[1]] = index
                index = (padded.reshape(image.shape[0], wide, -1) << (np.arange(1 << pack, dtype=np.uint32) * each)).sum(axis=2).astype(np.uint32)
            image = (index << np.uint32(8)) | np.uint32(0xFF000000)
        else:
            image = _green(image, -1)
    w.put(0, 1)
    _write_pixels(w, image, True, cache_bits, references, tile)
    return _riff(w.bytes())


#: Shortest reference that the encoder writes.
LEAST_MATCH = 32
_EIGHT = 8


@functools.lru_cache(8)
def _near(width: int) -> dict[int, int]:
    """Distance -> code of the near distances."""
    return {max(x + y * width, 1): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def references(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of passages that occurred before, in order and without overlap."""
    n = len(flat) - _EIGHT + 1
    if n < LEAST_MATCH - _EIGHT + 2:
        return []
    runs = np.ascontiguousarray(np.lib.stride_tricks.as_strided(flat, (n, _EIGHT), (1, 1))).view(np.uint64).ravel()
    room = np.uint64(max(n - 1, 1).bit_length())
    # runs that are alike stand together, in order of their places
    keys = np.sort((runs * np.uint64(0x9E3779B97F4A7C15) >> room) << room | np.arange(n, dtype=np.uint64))
    places = (keys & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)
    alike = np.flatnonzero(runs[places[1:]] == runs[places[:-1]])
    back = np.zeros(n, np.int64)
    back[places[alike + 1]] = places[alike + 1] - places[alike]
    # a passage at one distance is a stretch of equal steps back
    starts = np.concatenate([[0], np.flatnonzero(np.diff(back)) + 1])
    sizes = np.diff(np.append(starts, n))
    good = np.flatnonzero((sizes >= LEAST_MATCH - _EIGHT + 1) & (back[starts] > 0))
    out, at = [], 0
    for start, size, distance in zip(starts[good].tolist(), sizes[good].tolist(), back[starts[good]].tolist(), strict=True):
        a, end = max(start, at), start + size + _EIGHT - 1
        while end - a >= LEAST_MATCH:
            length = min(end - a, 4096)
            out.append((a, length, distance))
            a += length
        at = max(at, a if out and out[-1][0] >= start else at)
    return out


def _write_green(w: Writer, flat: np.ndarray, width: int, alpha: int) -> None:
    """One group, no cache: green as given, with references; red and blue 0."""
    w.put(0, 2)  # no cache, one group
    found = references(flat)
    near = _near(width)
    counts = np.zeros(LITERALS + LENGTHS, np.int64)
    distances = np.zeros(DISTANCES, np.int64)
    pieces, at = [], 0
    for place, length, distance in found:
        pieces.append((flat[at:place], _prefix(length), _prefix(near.get(distance, distance + len(NEAR)))))
        at = place + length
        counts[LITERALS + pieces[-1][1][0]] += 1
        distances[pieces[-1][2][0]] += 1
    literal = np.concatenate([*(x[0] for x in pieces), flat[at:]])
    counts[:LITERALS] += np.bincount(literal, minlength=LITERALS)
    solid = np.zeros(LITERALS, np.int64)
    solid[alpha] = 1
    zero = np.zeros(LITERALS, np.int64)
    zero[0] = 1
    code, length = _write_code(w, counts)
    for t in (zero, zero, solid):
        _write_code(w, t)
    far, far_length = _write_code(w, distances)
    for part, (size, extra, bits), (step, more, more_bits) in pieces:
        if len(part):
            w.many(code[part], length[part])
        w.put(int(code[LITERALS + size]), int(length[LITERALS + size]))
        w.put(extra, bits)
        w.put(int(far[step]), int(far_length[step]))
        w.put(more, more_bits)
    if at < len(flat):
        w.many(code[flat[at:]], length[flat[at:]])


def _entropy(values: np.ndarray) -> float:
    """Bits of the values by their own frequencies."""
    counts = np.bincount(values, minlength=1)
    counts = counts[counts > 0]
    return float((counts * np.log2(len(values) / counts)).sum())


def encode_grey(samples: np.ndarray) -> bytes:
    """WebP file of 8-bit samples (height, width), in the smaller of its forms (see the top)."""
    height, width = samples.shape
    flat = np.ascontiguousarray(samples).ravel()
    levels = np.flatnonzero(np.bincount(flat, minlength=256))
    w = Writer()
    _header(w, width, height)
    if len(levels) <= 16:
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(levels) - 1, 8)
        colors = levels.astype(np.uint32) * np.uint32(0x10101) | np.uint32(0xFF000000)
        deltas = np.diff(colors.astype("<u4").view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
        _write_pixels(w, np.ascontiguousarray(deltas).view("<u4").reshape(1, -1), False)
        place = np.zeros(256, np.uint8)
        place[levels] = np.arange(len(levels))
        pack = _pack_bits(len(levels))
        wide = -(-width >> pack)
        index = np.zeros((height, wide << pack), np.uint8)
        index[:, :width] = place[samples]
        index = (index.reshape(height, wide, -1) << (np.arange(1 << pack, dtype=np.uint8) * (8 >> pack))).sum(axis=2, dtype=np.uint8)
        w.put(0, 1)
        _write_green(w, index.ravel(), wide, 255)
        return _riff(w.bytes())
    best, mode, plain = _entropy(flat), 0, flat
    for kind, prediction in ((1, flat[:-1]), (2, flat[:-width])):
        rest = (flat[len(flat) - len(prediction) :] - prediction).astype(np.uint8)
        if len(rest) and (bits := _entropy(rest) + 8 * (len(flat) - len(rest)) + 64) < best:
            best, mode = bits, kind
    if mode:
        w.put(1, 1)
        w.put(PREDICTOR, 2)
        w.put(7, 3)
        modes = np.full((-(-height >> 9), -(-width >> 9)), mode << 8, np.uint32)
        _write_pixels(w, modes, False)
        image = samples.astype(np.uint32) * np.uint32(0x10101) | np.uint32(0xFF000000)
        plain = (_predict(image, modes, 9, False) & 255).astype(np.uint8).ravel()
    w.put(1, 1)
    w.put(SUBTRACT_GREEN, 2)
    w.put(0, 1)
    _write_green(w, plain, width, 0 if mode else 255)
    return _riff(w.bytes())


def decode_grey(data: bytes) -> list[np.ndarray]:
    """8-bit samples of each file in ``data``."""
    out = []
    for stream in frames(data):
        image = decode_vp8l(stream)
        grey = (image & 255).astype(np.uint8)
        if not np.array_equal(image, grey.astype(np.uint32) * np.uint32(0x10101) | np.uint32(0xFF000000)):
            raise BadImage("image isn't grey")
        out.append(grey)
    return out
