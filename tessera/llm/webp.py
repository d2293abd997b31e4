"""Lossless WebP: a decoder of the whole bitstream, an encoder, and a form that stores text bytes as pixels.

Text bytes become the green samples of images 64 pixels wide; what exceeds a frame goes to further frames of one file.
Files are decoded side by side, a pixel of each at a time, with prefix codes, back-references and colour cache; then all
transforms are inverted. Streams with meta codes are decoded alone, pixel by pixel.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Scratch, ship, table

ship(__name__)

WIDTH, ROWS = 64, 64
#: Bits of the longest code that the encoder writes for text, so that a look-up table has 4096 entries.
LONGEST = 12
#: The shortest copy that is written, about as long as a literal run of its bits; and the least payload with a palette.
SHORTEST, PALETTE_BYTES = 10, 512
#: Bytes of payload that a task encodes and decodes side by side.
AT_ONCE = 3_000_000
#: Bytes of payload whose codes are laid out at once, so few that memory is used again.
CACHED = 400_000

#: Fixed values of the format: the order of code length codes, and the near distances as (left, up).
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
NEAR_PAIRS = np.array(NEAR)
BLACK = 0xFF000000
CACHE_FACTOR = 0x1E35A7BD


# --- bits and prefix codes


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.value, self.at, self.size = int.from_bytes(data[:256], "little"), 0, len(data)
        self.data, self.base = data, 0

    def peek(self, n: int) -> int:
        if self.at - self.base > 1_024:  # keep the integer short
            byte = self.at >> 3
            self.value, self.base = int.from_bytes(self.data[byte : byte + 256], "little"), byte << 3
        return (self.value >> (self.at - self.base)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > 8 * self.size:
            raise ValueError("the stream ends early")
        out = self.peek(n)
        self.at += n
        return out


class Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.size // 8), "little")


_REVERSED = [int(f"{k:08b}"[::-1], 2) for k in range(256)]


def reversed_bits(code: int, n: int) -> int:
    return (_REVERSED[code & 255] << 8 | _REVERSED[code >> 8]) >> (16 - n)


def canonical(lengths: Sequence[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code as it stands in the stream, bits). A lone symbol has no bits."""
    return _canonical(sorted((n, s) for s, n in enumerate(lengths) if n))


def _canonical(used: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, code, last = {}, 0, 0
    for n, s in used:
        code <<= n - last
        out[s] = (reversed_bits(code, n), n)
        code, last = code + 1, n
    if used and code != 1 << last:
        raise ValueError("a prefix code is not complete")
    return out


class Code:
    """Decodes one prefix code by a dictionary of (bits, code)."""

    def __init__(self, lengths: Sequence[int]):
        self.codes = canonical(lengths)
        self.by = {(n, c): s for s, (c, n) in self.codes.items()}
        self.sizes = sorted({n for n, _ in self.by})
        self.only = next(iter(self.codes)) if len(self.codes) == 1 else None

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        ahead = bits.peek(15)
        for n in self.sizes:
            s = self.by.get((n, ahead & ((1 << n) - 1)))
            if s is not None:
                bits.at += n
                if bits.at > 8 * bits.size:
                    raise ValueError("the stream ends early")
                return s
        raise ValueError("no such code")


@functools.lru_cache(64)
def _length_code(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    """(symbol, bits) of a code of code lengths, for each seven bits that may come."""
    out = [(0, 0)] * 128
    for s, (c, n) in canonical(lengths).items():
        out[c :: 1 << n] = [(s, n)] * (128 >> n)
    return out


def read_code(bits: Bits, alphabet: int) -> list[int]:
    """Code lengths of the symbols of an alphabet."""
    lengths = [0] * max(alphabet, 256)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lengths
    first = [0] * 19
    for k in range(4 + bits.read(4)):
        first[CODE_ORDER[k]] = bits.read(3)
    code = _length_code(tuple(first))
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    last, at, begin = 8, 0, bits.at >> 3
    ahead, k = int.from_bytes(bits.data[begin : begin + 2 * alphabet], "little"), bits.at & 7  # 14 bits a symbol at most
    while at < alphabet and most:
        most -= 1
        s, n = code[ahead >> k & 127]
        k += n
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
        else:
            more, n = ((2, 3), (3, 3), (7, 11))[s - 16]
            n += ahead >> k & (1 << more) - 1
            k += more
            if at + n > alphabet:
                raise ValueError("code lengths beyond the alphabet")
            lengths[at : at + n] = [last if s == 16 else 0] * n
            at += n
    bits.at = 8 * begin + k
    if bits.at > 8 * bits.size:
        raise ValueError("the stream ends early")
    return lengths


def huffman(counts: dict[int, int], longest: int) -> dict[int, int]:
    """Code lengths of at most `longest` bits; scarce symbols are counted as more until they fit."""
    if len(counts) < 3:
        return dict.fromkeys(counts, 1)
    floor = 1
    while True:
        heap = [(max(n, floor), s, None) for s, n in sorted(counts.items())]
        heapq.heapify(heap)
        tie = 1 << 20
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            tie += 1
            heapq.heappush(heap, (a[0] + b[0], tie, (a, b)))
        out, stack = {}, [(heap[0], 0)]
        while stack:
            (_, s, below), depth = stack.pop()
            if below is None:
                out[s] = depth
            else:
                stack += [(below[0], depth + 1), (below[1], depth + 1)]
        if max(out.values()) <= longest:
            return out
        floor *= 4


#: Lengths are written with a fixed code of four bits for 0-12, 16-18: its symbols, and what goes before them (54 bits).
_LENGTHS = {s: reversed_bits(k, 4) for k, s in enumerate((*range(13), 16, 17, 18))}
_LENGTHS_HEAD = 12 << 1 | sum(4 << 5 + 3 * k for k in range(16))


def write_code(out: Writer, lengths: dict[int, int], alphabet: int) -> dict[int, tuple[int, int]]:
    """Writes a code and returns its symbols' codes."""
    used = sorted(lengths)
    if not used or (len(used) <= 2 and used[-1] < 256):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(used[0] > 1, 1)
        out.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            out.put(used[1], 8)
            return {used[0]: (0, 1), used[1]: (1, 1)}
        return {used[0]: (0, 0)}
    value, size, at = _LENGTHS_HEAD, 54, 0
    for s in [*used, alphabet]:
        gap = s - at
        while gap:
            n = min(gap, 138)
            if n < 3:
                n = 1
                value |= _LENGTHS[0] << size
                size += 4
            elif n < 11:
                value |= (_LENGTHS[17] | n - 3 << 4) << size
                size += 7
            else:
                value |= (_LENGTHS[18] | n - 11 << 4) << size
                size += 11
            gap -= n
        if s < alphabet:
            value |= _LENGTHS[lengths[s]] << size
            size += 4
        at = s + 1
    out.put(value, size)
    return _canonical(sorted((n, s) for s, n in lengths.items()))


# --- decoding any stream


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_image(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """The ARGB values of an entropy-coded image, before any transform."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, meta_bits, groups = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        across = -(-width >> meta_bits)
        meta = [(p >> 8) & 0xFFFF for p in read_image(bits, across, -(-height >> meta_bits), False)]
        groups = max(meta) + 1
    codes = [[Code(read_code(bits, n)) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    cache = [0] * (1 << cache_bits) if cache_bits else []
    out: list[int] = []
    total, group, cached = width * height, codes[0], 0
    while len(out) < total:
        if meta is not None:
            y, x = divmod(len(out), width)
            group = codes[meta[(y >> meta_bits) * across + (x >> meta_bits)]]
        s = group[0].read(bits)
        if s < 256:
            red = group[1].read(bits)
            blue = group[2].read(bits)
            out.append(group[3].read(bits) << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            n = _value(bits, s - 256)
            d = _value(bits, group[4].read(bits))
            if d > 120:
                d -= 120
            else:
                left, up = NEAR[d - 1]
                d = max(1, left + up * width)
            if d > len(out) or len(out) + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out.append(out[-d])
        else:
            for p in out[cached:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            cached = len(out)
            out.append(cache[s - 280])
        if cache_bits and len(out) - cached > 4096:
            for p in out[cached:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            cached = len(out)
    return out


def _split(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(c: Sequence[int]) -> int:
    return (c[0] & 255) << 24 | (c[1] & 255) << 16 | (c[2] & 255) << 8 | c[3] & 255


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """The predicted value; corner is above left, right above right."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _mean(_mean(left, right), top)
    if mode == 6:
        return _mean(left, corner)
    if mode == 7:
        return _mean(left, top)
    if mode == 8:
        return _mean(corner, top)
    if mode == 9:
        return _mean(top, right)
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, right))
    if mode == 11:
        parts = list(zip(_split(left), _split(top), _split(corner), strict=True))
        to_left = sum(abs(t - c) for _, t, c in parts)
        to_top = sum(abs(x - c) for x, _, c in parts)
        return left if to_left < to_top else top
    if mode == 12:
        return _join([_clamp(x + t - c) for x, t, c in zip(_split(left), _split(top), _split(corner), strict=True)])
    if mode == 13:
        return _join([_clamp(m + int((m - c) / 2)) for m, c in zip(_split(_mean(left, top)), _split(corner), strict=True)])
    return BLACK


def predicted(pixels: list[int], width: int, modes: list[int], size_bits: int, inverse: bool) -> list[int]:
    """Adds (inverse) or subtracts the predictions; both see the original pixels that come before."""
    out: list[int] = []
    known = out if inverse else pixels
    across = -(-width >> size_bits)
    for k, p in enumerate(pixels):
        y, x = divmod(k, width)
        if not k:
            guess = BLACK
        elif not y:
            guess = known[k - 1]
        elif not x:
            guess = known[k - width]
        else:
            mode = modes[(y >> size_bits) * across + (x >> size_bits)] >> 8 & 15
            guess = predict(mode, known[k - 1], known[k - width], known[k - width - 1], known[k - width + 1])
        a, b = _split(p), _split(guess)
        out.append(_join([i + j if inverse else i - j for i, j in zip(a, b, strict=True)]))
    return out


def predicted_alike(pixels: np.ndarray, width: int, mode: int, inverse: bool) -> np.ndarray:
    """predicted() where all blocks have mode 1 (left) or 2 (top), by sums or differences over rows and columns."""
    c = (pixels.reshape(-1, width, 1) >> np.array([24, 16, 8, 0]) & 255).astype(np.uint8)
    out, own = c.copy(), 1 if mode == 1 else 0
    if inverse:
        out[0, 0, :1] += 255
        edge = np.cumsum(out[:, 0] if own else out[0], axis=0, dtype=np.uint8)
        out[(slice(None), 0) if own else 0] = edge
        out = np.cumsum(out, axis=own, dtype=np.uint8)
    else:
        if own:
            out[:, 1:] -= c[:, :-1]
            out[1:, 0] -= c[:-1, 0]
        else:
            out[1:] -= c[:-1]
            out[0, 1:] -= c[0, :-1]
        out[0, 0, :1] -= 255
    return (out.astype(np.int64) << np.array([24, 16, 8, 0])).sum(axis=2).ravel()


def cross_coloured(pixels: np.ndarray, width: int, factors: np.ndarray, size_bits: int, inverse: bool) -> np.ndarray:
    at = np.arange(len(pixels))
    across = -(-width >> size_bits)
    f = factors[(at // width >> size_bits) * across + (at % width >> size_bits)]
    signed = lambda v: (v & 255).astype(np.uint8).astype(np.int8).astype(np.int64)
    delta = lambda t, c: (signed(t) * signed(c)) >> 5
    red, green, blue = pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255
    if inverse:
        red = red + delta(f, green) & 255
        blue = blue + delta(f >> 8, green) + delta(f >> 16, red) & 255
    else:
        blue = blue - delta(f >> 8, green) - delta(f >> 16, red) & 255
        red = red - delta(f, green) & 255
    return pixels & 0xFF00FF00 | red << 16 | blue


def read_head(bits: Bits) -> tuple[int, int, int, list[tuple]]:
    """(width of the coded image, width, height, transforms) of a VP8L chunk's payload, up to its main image."""
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless WebP stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    todo, whole = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in todo]:
            raise ValueError("a transform comes twice")
        if kind < 2:
            size = bits.read(3) + 2
            todo.append((kind, size, read_image(bits, -(-width >> size), -(-height >> size), False), width))
        elif kind == 2:
            todo.append((kind, 0, [], width))
        else:
            n = bits.read(8) + 1
            palette, last = [], (0, 0, 0, 0)
            for p in read_image(bits, n, 1, False):
                last = tuple(a + b & 255 for a, b in zip(_split(p), last, strict=True))
                palette.append(_join(last))
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, packed, palette, width))
            width = -(-width >> packed)
    return width, whole, height, todo


def inverted(pixels: np.ndarray, todo: list[tuple], height: int) -> np.ndarray:
    """The image (flat) after all transforms, the last one first."""
    for kind, size, extra, own in reversed(todo):
        if kind == 0 and len(modes := {m >> 8 & 15 for m in extra}) == 1 and modes <= {1, 2}:
            pixels = predicted_alike(pixels, own, modes.pop(), True)
        elif kind == 0:
            pixels = np.array(predicted(pixels.tolist(), own, extra, size, True), np.int64)
        elif kind == 1:
            pixels = cross_coloured(pixels, own, np.array(extra, np.int64), size, True)
        elif kind == 2:
            green = pixels >> 8 & 255
            pixels = pixels & 0xFF00FF00 | ((pixels >> 16) + green & 255) << 16 | (pixels + green & 255)
        else:
            x = np.arange(own)
            index = (pixels.reshape(height, -1)[:, x >> size] >> 8 & 255) >> ((x & (1 << size) - 1) * (8 >> size)) & (1 << (8 >> size)) - 1
            colours = np.zeros(256, np.int64)
            colours[: len(extra)] = extra
            pixels = colours[index].ravel()
    return pixels


def decode_stream(data: bytes) -> np.ndarray:
    """ARGB values (height, width) of a VP8L chunk's payload."""
    bits = Bits(data)
    width, whole, height, todo = read_head(bits)
    pixels = np.array(read_image(bits, width, height, True), np.int64)
    return inverted(pixels, todo, height).reshape(height, whole)


# --- encoding any image


def _tokens(pixels: list[int], width: int, cache_bits: int, copies: bool) -> Iterator[tuple]:
    """Literals (0, argb), copies (1, length, distance code) of what stands left or above, and cache hits (2, index)."""
    cache = [0] * (1 << cache_bits) if cache_bits else []
    k = 0
    while k < len(pixels):
        best = (0, 0)
        if copies:
            for code, d in ((1, width), (2, 1), (120 + 7 * width, 7 * width)):
                n = 0
                while k + n < len(pixels) and n < 4096 and d <= k and pixels[k + n] == pixels[k + n - d]:
                    n += 1
                best = max(best, (n, code))
        n = best[0] if best[0] >= 3 else 1
        place = (CACHE_FACTOR * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if n > 1:
            yield 1, n, best[1]
        elif cache_bits and cache[place] == pixels[k]:
            yield 2, place
        else:
            yield 0, pixels[k]
        for p in pixels[k : k + n] if cache_bits else ():
            cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        k += n


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    extra = v.bit_length() - 2
    return 2 * extra + 2 + (v >> extra & 1), v & (1 << extra) - 1, extra


def write_image(out: Writer, pixels: list[int], width: int, main: bool, cache_bits: int = 0, copies: bool = False, meta_bits: int = 0) -> None:
    """An entropy-coded image. meta_bits splits a main image into blocks, whose codes are those of two groups by turns."""
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    height, across = len(pixels) // width, -(-width >> meta_bits)
    if main:
        out.put(bool(meta_bits), 1)
    group = lambda k: 0
    if main and meta_bits:
        out.put(meta_bits - 2, 3)
        blocks = [(k & 1) << 8 for k in range(across * -(-height >> meta_bits))]
        write_image(out, blocks, across, False)
        group = lambda k: blocks[(k // width >> meta_bits) * across + (k % width >> meta_bits)] >> 8
    stream, k = [], 0
    counts = [[{} for _ in range(5)] for _ in range(2 if main and meta_bits and len(blocks) > 1 else 1)]
    for t in _tokens(pixels, width, cache_bits, copies):
        own = group(k)
        if t[0] == 0:
            a, r, g, b = _split(t[1])
            symbols = [(0, g), (1, r), (2, b), (3, a)]
        elif t[0] == 1:
            (p, e, n), (q, f, m) = _prefix(t[1]), _prefix(t[2])
            symbols = [(0, 256 + p), (-1, e, n), (4, q), (-1, f, m)]
        else:
            symbols = [(0, 280 + t[1])]
        for s in symbols:
            if s[0] >= 0:
                counts[own][s[0]][s[1]] = counts[own][s[0]].get(s[1], 0) + 1
        stream.append((own, symbols))
        k += t[1] if t[0] == 1 else 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[write_code(out, huffman(c, LONGEST), n) for c, n in zip(own, sizes, strict=True)] for own in counts]
    for own, symbols in stream:
        for s in symbols:
            out.put(*(codes[own][s[0]][s[1]] if s[0] >= 0 else s[1:]))


def encode_stream(pixels: np.ndarray, predictor: int | None = None, cross: int | None = None, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, copies: bool = True, meta_bits: int = 0) -> bytes:
    """A VP8L payload of ARGB values (height, width), with the transforms asked for, in the order palette, predictor, cross, green."""
    height, width = pixels.shape
    out = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    now, own = pixels.astype(np.int64).ravel(), width
    if palette:
        colours = np.unique(now)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        out.put(7, 3)  # one more transform, of kind 3
        out.put(len(colours) - 1, 8)
        last, deltas = (0, 0, 0, 0), []
        for p in map(_split, colours.tolist()):
            deltas.append(_join([a - b for a, b in zip(p, last, strict=True)]))
            last = p
        write_image(out, deltas, len(deltas), False)
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        own = -(-width >> packed)
        index = np.zeros((height, own << packed), np.int64)
        index[:, :width] = np.searchsorted(colours, now).reshape(height, width)
        place = np.arange(1 << packed) * (8 >> packed)
        now = BLACK | (index.reshape(height, own, -1) << place).sum(axis=2).ravel() << 8
    if predictor is not None:
        out.put(1, 3)
        out.put(0, 3)
        modes = [((predictor + k if predictor > 13 else predictor) % 14) << 8 for k in range(-(-own >> 2) * -(-height >> 2))]
        write_image(out, modes, -(-own >> 2), False)
        now = np.array(predicted(now.tolist(), own, modes, 2, False), np.int64)
    if cross is not None:
        out.put(3, 3)
        out.put(1, 3)
        factors = [(cross * (k + 1)) & 0xFFFFFF for k in range(-(-own >> 3) * -(-height >> 3))]
        write_image(out, factors, -(-own >> 3), False)
        now = cross_coloured(now, own, np.array(factors, np.int64), 3, False)
    if subtract_green:
        out.put(5, 3)
        green = now >> 8 & 255
        now = now & 0xFF00FF00 | ((now >> 16) - green & 255) << 16 | (now - green & 255)
    out.put(0, 1)
    write_image(out, now.tolist(), own, True, cache_bits, copies, meta_bits)
    return out.bytes()


# --- files


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _u24(n: int) -> bytes:
    return struct.pack("<I", n)[:3]


def write_file(frames: Sequence[tuple[bytes, int, int]]) -> bytes:
    """A WebP file of VP8L payloads (data, width, height): one image, or frames below each other, shown together."""
    if len(frames) == 1:
        body = _chunk(b"VP8L", frames[0][0])
    else:
        width, height = frames[0][1], sum(f[2] for f in frames)
        body = _chunk(b"VP8X", b"\x02\0\0\0" + _u24(width - 1) + _u24(height - 1)) + _chunk(b"ANIM", b"\0" * 6)
        y = 0
        for data, w, h in frames:
            body += _chunk(b"ANMF", _u24(0) + _u24(y // 2) + _u24(w - 1) + _u24(h - 1) + _u24(0) + b"\x02" + _chunk(b"VP8L", data))
            y += h
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def read_file(data: bytes) -> list[bytes]:
    """The VP8L payloads of a file, in the order of its frames."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out, stack = [], [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
    while stack:
        at, end = stack.pop()
        if at + 8 > end:
            continue
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > len(data):
            raise ValueError("a chunk ends beyond the file")
        stack.append((at + 8 + size + (size & 1), end))
        if name == b"VP8L":
            out.append(data[at + 8 : at + 8 + size])
        elif name == b"ANMF":
            stack.append((at + 8 + 16, at + 8 + size))
    return out


# --- text bytes, many files side by side


def payload_of(text: str | None) -> bytes:
    """UTF-8, with bytes 0 up to a positive multiple of 64; a null text is as an empty one."""
    raw = (text or "").encode()
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def encode_payloads(payloads: Sequence[bytes]) -> list[bytes]:
    """A file for each payload (a multiple of 64 bytes): green samples, the other channels constant.

    What stood before in a frame is copied where that is shorter; a payload of few different values has a palette whose
    indexes share a sample; one whose samples change little from left to right or from row to row has a predictor. The
    shortest file stays. Its frames share their codes. A colour cache isn't tried; the colour transforms can only lengthen
    samples of one channel, as the other channels take no bits.
    """
    out: list[bytes] = []
    held: list[bytes] = []
    room = CACHED
    for p in payloads:
        if held and room < len(p):
            out += _shortest(held)
            held, room = [], CACHED
        held.append(p)
        room -= len(p)
    return out + (_shortest(held) if held else [])


def _modes(payloads: Sequence[bytes]) -> np.ndarray:
    """The predictor that may pay for each payload: 1 (left) or 2 (top), where the steps have a tenth less entropy than the samples, else 0."""
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    size = np.fromiter(map(len, payloads), np.int64, len(payloads))
    base = np.repeat(np.arange(len(payloads), dtype=np.int64) << 8, size)
    cost = []
    for back in (0, 1, WIDTH):
        step = flat.copy()
        if back:
            step[back:] -= flat[:-back]
        seen = np.bincount(base + step, minlength=len(payloads) << 8).reshape(-1, 256)
        cost.append(size * np.log2(size) - (seen * np.log2(np.maximum(seen, 1))).sum(axis=1))
    best = np.where(cost[2] < cost[1], 2, 1)
    return np.where(np.minimum(cost[1], cost[2]) < 0.9 * cost[0], best, 0)


def _shortest(payloads: Sequence[bytes]) -> list[bytes]:
    """_encode(), and with the predictor where that may pay; the shorter file stays."""
    out, modes = _encode(payloads), _modes(payloads)
    for mode in (1, 2):
        own = np.flatnonzero(modes == mode).tolist()
        for k, other in zip(own, _encode([payloads[k] for k in own], mode) if own else [], strict=True):
            out[k] = min(out[k], other, key=len)
    return out


def _steps(raw: np.ndarray, mode: int) -> np.ndarray:
    """The green residuals of a payload's frames."""
    parts = []
    for at in range(0, len(raw), WIDTH * ROWS):
        own = raw[at : at + WIDTH * ROWS].reshape(-1, WIDTH)
        out = own.copy()
        if mode == 1:
            out[:, 1:] -= own[:, :-1]
            out[1:, 0] -= own[:-1, 0]
        else:
            out[1:] -= own[:-1]
            out[0, 1:] -= own[0, :-1]
        parts.append(out.ravel())
    return np.concatenate(parts)


def _near_codes(width: int) -> np.ndarray:
    """The distance code of each distance below 8 rows."""
    out = np.arange(8 * width + 9) + 120
    for code in range(120, 0, -1):
        left, up = NEAR[code - 1]
        d = max(1, left + up * width)
        if d < len(out):
            out[d] = code
    return out


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_prefix() of many values."""
    v = value - 1
    extra = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 2, 0)
    extra[value <= 4] = 0
    return np.where(value <= 4, v, 2 * extra + 2 + (v >> extra & 1)), np.where(value <= 4, 0, v & (1 << extra) - 1), extra


def _grouped(key: np.ndarray) -> np.ndarray:
    """Places by key, equal keys in their order: a sort of hashes that carry their places, unless two keys share a hash."""
    bits = len(key).bit_length()
    if bits < 24:
        place = np.uint64((1 << bits) - 1)
        mixed = np.sort((key * np.uint64(0x9E3779B97F4A7C15)) & ~place | np.arange(len(key), dtype=np.uint64))
        order = (mixed & place).astype(np.int64)
        found = key[order]
        if not ((found[1:] != found[:-1]) & ((mixed[1:] ^ mixed[:-1]) <= place)).any():
            return order
    return np.argsort(key, kind="stable")


def _copies(flat: np.ndarray, frame: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of the copies of a greedy parse: the last earlier place in the frame with the same eight samples."""
    n = len(flat) - 7
    if n < 2:
        return (np.zeros(0, np.int64),) * 3
    key = np.lib.stride_tricks.as_strided(flat, (n, 8), (1, 1)).copy().view(np.uint64).ravel()
    order = _grouped(key)
    same = key[order[1:]] == key[order[:-1]]
    at, before = order[1:][same], order[:-1][same]
    inside = (frame[at] == frame[before]) & (at + 8 <= ends[frame[at]])
    distance = np.zeros(n + 1, np.int64)
    distance[at[inside]] = (at - before)[inside]
    cuts = np.flatnonzero(np.diff(distance, prepend=0) | np.diff(np.append(frame[:n], -1), prepend=0))
    sizes, d = np.diff(cuts, append=n), distance[cuts]
    rows, free = [], 0
    for start, size, far in zip(cuts[d > 0].tolist(), sizes[d > 0].tolist(), d[d > 0].tolist(), strict=True):
        begin = max(start, free)
        length = start + size - begin + 7
        if length >= SHORTEST:
            rows.append((begin, min(length, 4096), far))
            free = begin + min(length, 4096)
    return tuple(np.array(rows, np.int64).reshape(-1, 3).T)


def _encode(payloads: Sequence[bytes], mode: int = 0) -> list[bytes]:
    """Files of payloads, all with the predictor `mode` and no palette, or with palettes where values are few."""
    shift, palettes, samples = [], [], []
    for p in payloads:
        raw = np.frombuffer(p, np.uint8)
        used = np.flatnonzero(np.bincount(raw, minlength=256))
        k = 0 if mode or len(p) < PALETTE_BYTES or len(used) > 16 else 3 if len(used) <= 2 else 2 if len(used) <= 4 else 1
        shift.append(k)
        palettes.append(used.tolist() if k else None)
        samples.append(_steps(raw, mode) if mode else raw if not k else (np.searchsorted(used, raw).astype(np.uint8).reshape(-1, 1 << k) << (np.arange(1 << k) * (8 >> k)).astype(np.uint8)).sum(axis=1, dtype=np.uint8))
    shift = np.array(shift)
    size = np.fromiter(map(len, samples), np.int64, len(samples))
    most = WIDTH * ROWS >> shift  # samples of a frame
    frames = -(-size // most)
    owner = np.repeat(np.arange(len(payloads)), frames)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    count = np.minimum(most[owner], size[owner] - within * most[owner])
    last = np.cumsum(count)
    flat, frame = np.concatenate(samples), np.repeat(np.arange(len(owner)), count)
    place, length, distance = _copies(flat, frame, last)

    # Items: a literal's code; or a length's code and extra bits, and a distance's.
    many = np.ones(len(flat), np.int64)
    inner = np.repeat(place, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    many[inner] = 0
    many[place] = 2
    upto = np.cumsum(many)
    first = upto - many
    total = int(upto[-1])
    symbol, extra, bits = np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.int64)
    literal = np.flatnonzero(many == 1)
    symbol[first[literal]] = flat[literal]
    (p, e, n), at = _prefixes(length), first[place]
    symbol[at], extra[at], bits[at] = 256 + p, e, n
    code = distance + 120
    for k in range(4):
        own = np.flatnonzero(shift[owner[frame[place]]] == k)
        near = _near_codes(WIDTH >> k)
        few = own[distance[own] < len(near)]
        code[few] = near[distance[few]]
    (p, e, n), at = _prefixes(code), first[place] + 1
    symbol[at], extra[at], bits[at] = 280 + p, e, n
    items = np.add.reduceat(many, last - count)
    of_payload = np.repeat(owner, items)
    key = of_payload * 320 + symbol
    seen = np.bincount(key, minlength=320 * len(payloads)).reshape(-1, 320)

    heads, codes = [], np.zeros((len(payloads), 320), np.uint64)  # code << 4 | bits
    for k, palette in enumerate(palettes):
        w = Writer()
        if palette is not None:
            w.put(7, 3)
            w.put(len(palette) - 1, 8)
            write_image(w, [BLACK if not j else (b - a) << 8 for j, (a, b) in enumerate(zip([0, *palette], palette))] if palette[0] == 0 else [BLACK | palette[0] << 8, *((b - a) << 8 for a, b in zip(palette, palette[1:]))], len(palette), False)
        if mode:  # one block of 512 pixels
            w.put(1, 3)
            w.put(7, 3)
            write_image(w, [BLACK | mode << 8], 1, False)
        for _ in range(3):  # no more transforms, no cache, no meta codes
            w.put(0, 1)
        used = np.flatnonzero(seen[k, :280])
        green = write_code(w, huffman(dict(zip(used.tolist(), seen[k, used].tolist(), strict=True)), LONGEST), 280)
        for constant in (0, 0, 0 if mode else 255):
            write_code(w, {constant: 1}, 256)
        used = np.flatnonzero(seen[k, 280:])
        far = write_code(w, huffman(dict(zip(used.tolist(), seen[k, 280 + used].tolist(), strict=True)), LONGEST), 40)
        heads.append((w.value, w.size))
        codes[k, list(green)] = [c << 4 | n for c, n in green.values()]
        codes[k, [280 + x for x in far]] = [c << 4 | n for c, n in far.values()]

    found = codes.ravel()[key]
    own = (found & np.uint64(15)).astype(np.int64)
    value = found >> np.uint64(4) | extra << own.astype(np.uint64)
    own += bits
    ends = np.cumsum(own)
    closing = np.cumsum(items)
    body = np.diff(ends[closing - 1], prepend=0)
    head_bits = 40 + np.array([h[1] for h in heads], np.int64)[owner]  # 40: the stream's own header
    length = (head_bits + body + 7) // 8
    base = np.cumsum(length) - length
    start = ends - own + np.repeat(8 * base + head_bits - (np.cumsum(body) - body), items)
    value <<= (start & 31).astype(np.uint64)
    word = start >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums, place = np.add.reduceat(value, first), word[first]  # no two codes share a bit
    words = np.zeros(int(length.sum()) // 4 + 3, np.uint64)
    words[place] = sums & np.uint64(0xFFFFFFFF)
    words[place + 1] |= sums >> np.uint64(32)
    raw = words.astype("<u4").tobytes()
    files: list[list[tuple[bytes, int, int]]] = [[] for _ in payloads]
    for own, b, n, c in zip(owner.tolist(), base.tolist(), length.tolist(), count.tolist(), strict=True):
        h = (c << int(shift[own])) // WIDTH
        top = 0x2F | (WIDTH - 1) << 8 | (h - 1) << 22 | 1 << 36 | heads[own][0] << 40
        k = (40 + heads[own][1] + 7) // 8
        head = top | int.from_bytes(raw[b : b + k], "little")
        files[own].append((head.to_bytes(k, "little") + raw[b + k : b + n], WIDTH, h))
    return [write_file(f) for f in files]


#: Each LONGEST bits from the last to the first.
_REVERSED_PLACES = np.array([reversed_bits(k, LONGEST) for k in range(1 << LONGEST)])


@functools.lru_cache(256)
def _lone_table(symbol: int) -> np.ndarray:
    return np.full(1 << LONGEST, symbol << 4, np.uint16)


def _table(lengths: Sequence[int]) -> np.ndarray:
    """symbol << 4 | bits for each LONGEST bits that may come."""
    raw = bytes(lengths)
    many = len(raw) - raw.count(0)
    if many == 1:
        return _lone_table(raw.index(max(raw)))
    if not many:
        return np.zeros(1 << LONGEST, np.uint16)
    size = np.frombuffer(raw, np.uint8).astype(np.int64)
    used = np.argsort(size, kind="stable")[-many:]
    bits = size[used]
    times = 1 << LONGEST - bits
    if times.sum() != 1 << LONGEST:
        raise ValueError("a prefix code is not complete")
    return np.repeat((used << 4 | bits).astype(np.uint16), times)[_REVERSED_PLACES]


def _main_image(data: bytes) -> tuple | None:
    """(bits up to the pixels, coded width, height, transforms, cache bits, five tables) of a stream without meta codes and longer codes."""
    bits = Bits(data)
    width, _, height, todo = read_head(bits)
    cache_bits = bits.read(4) if bits.read(1) else 0
    if bits.read(1):
        return None
    codes = [read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    return None if max(map(max, codes)) > LONGEST else (bits.at, width, height, todo, cache_bits, [_table(c) for c in codes])


def decode_payloads(files: Sequence[bytes]) -> list[bytes]:
    """The green samples of each file, front to back: all streams side by side, a pixel of each at a time.

    A stream whose last symbol was a length copies a pixel a step until it is through. Streams with meta codes, or codes of
    more than LONGEST bits, go through decode_stream().
    """
    streams, owner, known = [], [], []
    parts: dict[tuple[int, int], bytes] = {}
    for k, data in enumerate(files):
        last = None  # frames of a file mostly share all but their height and pixels
        for f, stream in enumerate(read_file(data)):
            height = (int.from_bytes(stream[1:5], "little") >> 14 & 0x3FFF) + 1
            if last is not None and stream[:3] == last[0][:3] and len(stream) > last[1] and stream[5 : last[1]] == last[0][5 : last[1]] and (stream[last[1]] ^ last[0][last[1]]) & last[2] == 0 and not any(t[0] == 1 or t[0] == 0 and (len(t[2]) > 1 or height > 1 << t[1]) for t in last[3][3]):
                found = (*last[3][:2], height, *last[3][3:])
            else:
                found = _main_image(stream)
                if found is None:
                    parts[k, f] = (decode_stream(stream) >> 8 & 255).astype(np.uint8).tobytes()
                    continue
                last = (stream + b"\0", found[0] >> 3, (1 << (found[0] & 7)) - 1, found)
            streams.append(stream)
            owner.append((k, f))
            known.append(found)
    if streams:
        pixels = _side_by_side(streams, known)
        for key, (_, _, height, todo, *_), own in zip(owner, known, pixels, strict=True):
            parts[key] = (inverted(own.astype(np.int64), todo, height) >> 8 & 255).astype(np.uint8).tobytes() if todo else (own >> 8).astype(np.uint8).tobytes()
    joined: list[list[bytes]] = [[] for _ in files]
    for (k, _), part in sorted(parts.items()):
        joined[k].append(part)
    return [b"".join(x) for x in joined]


def _side_by_side(streams: list[bytes], known: list[tuple]) -> list[np.ndarray]:
    """The coded pixels (ARGB) of streams whose heads are known."""
    size = np.fromiter(map(len, streams), np.int64, len(streams))
    flat = np.frombuffer(b"".join(streams) + b"\0" * 16, np.uint8)
    ahead = np.lib.stride_tricks.as_strided(flat, (len(flat) - 8, 8), (1, 1)).copy().view(np.int64).ravel()  # eight bytes from each place; the sign is never among the bits that are read
    count = np.array([x[1] * x[2] for x in known])
    order = np.argsort(-count, kind="stable")
    base = np.cumsum(size) - size
    tables: dict[int, int] = {}
    for x in known:
        tables.setdefault(id(x[5]), len(tables))
    green, red, blue, alpha, far = (np.concatenate([t[c] for t in {id(x[5]): x[5] for x in known}.values()]) for c in range(5))
    at = (8 * base + np.array([x[0] for x in known]))[order]
    limit = (8 * (base + size))[order]
    row = np.array([tables[id(x[5])] for x in known])[order] << LONGEST
    count, width = count[order], np.array([x[1] for x in known])[order]
    cache_bits = np.array([x[4] for x in known])[order]
    cache_at = np.cumsum(np.where(cache_bits, 1 << cache_bits, 0)) - np.where(cache_bits, 1 << cache_bits, 0)
    cache = np.zeros(int(np.where(cache_bits, 1 << cache_bits, 0).sum()) + 1, np.uint32)
    flat_of = lambda t: (t[row] >> 4).astype(np.uint32)
    plain = bool(((red[row] | blue[row] | alpha[row]) & 15 == 0).all())  # all other channels constant
    rest = flat_of(alpha) << 24 | flat_of(red) << 16 | flat_of(blue)
    out = np.zeros((int(count[0]), len(streams)), np.uint32)
    left, back = np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64)
    live = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1), side="right")
    mask, copying = (1 << LONGEST) - 1, 0
    for t in range(int(count[0])):
        n = live[t]
        here = at[:n]
        word = ahead.take(here >> 3, mode="clip")
        word >>= here & 7
        got = green.take(row[:n] + (word & mask), mode="clip")
        if copying:
            got[left[:n] > 0] = 0
        bits, symbol = (got & 15).astype(np.int64), (got >> 4).astype(np.uint32)
        now = symbol << 8 | rest[:n]
        if not plain:
            lit = np.flatnonzero((symbol < 256) & (left[:n] == 0))
            now[lit] = symbol[lit] << 8
            for table, by in ((red, 16), (blue, 0), (alpha, 24)):
                own = table[row[lit] + (word[lit] >> bits[lit] & mask)]
                now[lit] |= (own >> 4).astype(np.uint32) << np.uint32(by)
                bits[lit] += own & 15
        new = (got >= 256 << 4).nonzero()[0]
        if len(new):
            hit = new[symbol[new] >= 280]
            now[hit] = cache[cache_at[hit] + symbol[hit].astype(np.int64) - 280]
            new = new[symbol[new] < 280]
            if len(new):
                value = []
                for prefix in (symbol[new].astype(np.int64) - 256, None):
                    if prefix is None:
                        own = far[row[new] + (word[new] >> bits[new] & mask)]
                        prefix = (own >> 4).astype(np.int64)
                        bits[new] += own & 15
                    extra = np.maximum((prefix - 2) >> 1, 0)
                    low = word[new] >> bits[new] & (1 << extra) - 1
                    value.append(np.where(prefix < 4, prefix + 1, (2 + (prefix & 1) << extra) + low + 1))
                    bits[new] += extra
                steps, d = value
                near = d <= 120
                pair = NEAR_PAIRS[d[near] - 1]
                d = d - 120
                d[near] = np.maximum(1, pair[:, 0] + pair[:, 1] * width[new][near])
                if (d > t).any() or (steps > count[new] - t).any():
                    raise ValueError("a back-reference leaves the image")
                left[new], back[new] = steps, d
                copying += len(new)
        if copying:
            busy = np.flatnonzero(left[:n])
            now[busy] = out[t - back[busy], busy]
            left[busy] -= 1
            copying -= int((left[busy] == 0).sum())
        if len(cache) > 1:
            own = np.flatnonzero(cache_bits[:n])
            cache[cache_at[own] + (now[own] * np.uint32(CACHE_FACTOR) >> (32 - cache_bits[own]).astype(np.uint32))] = now[own]
        out[t, :n] = now
        here += bits
    if (at > limit).any():
        raise ValueError("a stream ends early")
    out, found = np.ascontiguousarray(out.T), [None] * len(streams)
    for k, j in enumerate(order.tolist()):
        found[j] = out[k, : count[k]]
    return found


def feature_of(payload: bytes) -> str:
    """rows, sum, sum of squares, different values and sum of steps of the samples."""
    p = np.frombuffer(payload, np.uint8)
    counts, values = np.bincount(p, minlength=256), np.arange(256)
    steps = np.abs(np.diff(p.astype(np.int16))).sum(dtype=np.int64)
    return f"rows={len(p) // WIDTH};sum={counts @ values};squares={counts @ (values * values)};values={np.count_nonzero(counts)};steps={steps}"


def _in_parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield at, n
        at += n


def store_texts(docs: DataFrame) -> DataFrame:
    """(id, n_bytes, media) for docs (id, text): every whole text as a lossless WebP file.

    Null and empty texts are 64 bytes 0; equal texts have equal files; a text of any length is frames of 4096 samples;
    rows that repeat an id are stored each; other columns are left out; no rows give no rows. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _in_parts(np.array(pc.fill_null(pc.binary_length(batch.column(1)), 0)) + 64, AT_ONCE):
                texts = batch.column(1).slice(at, n).to_pylist()
                files = encode_payloads([payload_of(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])

    return docs.select("id", "text").mapInArrow(run, "id long, n_bytes long, media binary")


def read_media(stored: DataFrame, keep_pixels: bool = False) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, media, pixels]) for store_texts().

    All but n_bytes is read back from the stored files. pixels are the rows of samples, 64 a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _in_parts(np.array(pc.binary_length(batch.column(2))), AT_ONCE // 2):
                part = batch.slice(at, n)
                media = part.column(2).to_pylist()
                back = decode_payloads(media)
                columns = [
                    pa.array(map(len, back), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back]), pa.array([zlib.crc32(p[-64:]) for p in back], pa.int64()),
                    pa.array(map(len, media), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(map(feature_of, back)), *([part.column(2), pa.array(back, pa.binary())] if keep_pixels else []),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names)

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, pixels binary" * keep_pixels
    names = [x.split()[0] for x in schema.split(", ")]
    return stored.mapInArrow(run, schema)


def op3_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) AS id", "text")
    return read_media(Scratch(spark, "webp").put(store_texts(docs), "media")).withColumnRenamed("id", "doc_id")
