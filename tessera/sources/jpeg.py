"""Baseline JPEG with numpy: a coder whose strips are coded apart and joined, and a decoder of what tile servers send.

A file is a header, rows of blocks and an end. Each row of blocks is a restart interval, which depends on no other, so
strips of an image can be coded in different tasks and written one after the other. Colours are kept at full resolution.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np

#: Fixed values of ITU T.81: the order of coefficients, the quantisation tables that quality scales, and the prefix codes,
#: as numbers of codes of 1 to 16 bits and their symbols.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
LUMINANCE = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])
CHROMINANCE = np.array([17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66] + [99] * 38)
DC_CODES = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), bytes(range(12))
AC_CODES = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)

#: The quality that image tools of browsers are asked for, 0.95.
QUALITY = 95
#: Pixels of the largest image that decode() takes, as a header may claim any size.
LARGEST = 1 << 26

_k = np.arange(8)
#: The cosine transform of 8 samples as a matrix.
COSINES = np.where(_k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)


def quantisers(quality: int) -> tuple[np.ndarray, np.ndarray]:
    """The tables of brightness and colour for a quality of 1 to 100, in the order of rows."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return tuple(np.clip((t * scale + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE))


@functools.cache
def _codes(spec: tuple[tuple[int, ...], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code, bits) by symbol: codes of a length count up, and go on doubled at the next length."""
    code, values, sizes, at = 0, np.zeros(256, np.int64), np.zeros(256, np.int64), 0
    for bits, count in enumerate(spec[0], 1):
        for symbol in spec[1][at : at + count]:
            values[symbol], sizes[symbol] = code, bits
            code += 1
        at += count
        code <<= 1
    return values, sizes


def header(width: int, height: int, quality: int = QUALITY) -> bytes:
    """Everything before the rows of blocks; a restart interval is a row of blocks."""
    if not (0 < width < 65536 and 0 < height < 65536):
        raise ValueError(f"a JPEG can't be {width} x {height}")
    part = lambda mark, data: struct.pack(">BBH", 0xFF, mark, len(data) + 2) + data
    tables = b"".join(part(0xDB, bytes([i]) + t[ZIGZAG].astype(np.uint8).tobytes()) for i, t in enumerate(quantisers(quality)))
    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])
    codes = b"".join(part(0xC4, bytes([kind << 4]) + bytes(spec[0]) + spec[1]) for kind, spec in ((0, DC_CODES), (1, AC_CODES)))
    return b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + tables + part(0xC0, frame) + codes + part(0xDD, struct.pack(">H", -(-width // 8))) + part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


END = b"\xff\xd9"


def _quantised(pixels: np.ndarray, quality: int) -> np.ndarray:
    """(rows of blocks, blocks, components, 64): quantised coefficients in zigzag order of 8-bit RGB pixels."""
    h, w = pixels.shape[:2]
    rgb = np.pad(pixels, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float64)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    planes = np.stack((0.299 * r + 0.587 * g + 0.114 * b - 128, (b - (0.299 * r + 0.587 * g + 0.114 * b)) / 1.772, (r - (0.299 * r + 0.587 * g + 0.114 * b)) / 1.402))
    blocks = planes.reshape(3, rgb.shape[0] // 8, 8, rgb.shape[1] // 8, 8).transpose(1, 3, 0, 2, 4)
    found = COSINES @ blocks @ COSINES.T
    one, two = quantisers(quality)
    return np.rint(found.reshape(*found.shape[:3], 64) / np.stack((one, two, two))).astype(np.int64)[..., ZIGZAG]


def _sizes(values: np.ndarray) -> np.ndarray:
    """The number of bits of a number's magnitude."""
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def _row_bits(rows: np.ndarray, dc: tuple[np.ndarray, np.ndarray], ac: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """The coded bits of each row of blocks (rows, blocks, components, 64), filled up with ones."""
    diffs = np.diff(rows[:, :, :, 0], axis=1, prepend=0).ravel()
    flat = rows.reshape(-1, 64)
    n, per_row = len(flat), len(flat) // len(rows)
    block, at = np.nonzero(flat[:, 1:])
    at = at + 1
    values = flat[block, at]
    before = np.concatenate(([0], at))[: len(at)]
    before[np.concatenate(([True], block[1:] != block[:-1]))[: len(at)]] = 0
    runs = at - before - 1
    size, dsize = _sizes(values), _sizes(diffs)
    # Tokens: differences, coefficients, runs of 16 zeros before them, ends of blocks; each (place, code, bits).
    long = np.repeat(np.arange(len(at)), runs // 16)
    last = np.zeros(n, np.int64)
    last[block] = at
    ends = np.flatnonzero(last < 63)
    low = lambda v, s: np.where(v < 0, v + (1 << s) - 1, v)
    symbol = (runs % 16) << 4 | size
    place = np.concatenate((np.arange(n) * 256, block * 256 + at * 2 + 1, block[long] * 256 + at[long] * 2, ends * 256 + 255))
    code = np.concatenate((dc[0][dsize] << dsize | low(diffs, dsize), ac[0][symbol] << size | low(values, size), np.full(len(long), ac[0][0xF0]), np.full(len(ends), ac[0][0])))
    bits = np.concatenate((dc[1][dsize] + dsize, ac[1][symbol] + size, np.full(len(long), ac[1][0xF0]), np.full(len(ends), ac[1][0])))
    # And what fills each row up.
    length = np.bincount(place // (256 * per_row), bits, len(rows)).astype(np.int64)
    fill = -length % 8
    place = np.concatenate((place, np.arange(1, len(rows) + 1) * (256 * per_row) - 0.5))
    code, bits = np.concatenate((code, (1 << fill) - 1)), np.concatenate((bits, fill))
    order = np.argsort(place, kind="stable")
    code, bits = code[order], bits[order]
    token = np.repeat(np.arange(len(code)), bits)
    left = np.repeat(np.cumsum(bits), bits) - np.arange(len(token)) - 1
    data = np.packbits((code[token] >> left & 1).astype(np.uint8)).tobytes()
    cuts = np.concatenate(([0], np.cumsum((length + fill) // 8))).tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def encode_rows(pixels: np.ndarray, first: int = 0, last: bool = True, quality: int = QUALITY) -> bytes:
    """Rows of blocks of a strip of an image, pixels (height, width, 3); first is the strip's first row of blocks.

    A strip that isn't the last has a height of whole blocks. Strips one after the other, between header() and END, are
    the image's file.
    """
    if not last and len(pixels) % 8:
        raise ValueError("only an image's last strip may end within a row of blocks")
    dc, ac = _codes(DC_CODES), _codes(AC_CODES)
    out = []
    for at in range(0, len(pixels), 8 * 16):  # some rows at a time, which bounds memory
        for k, data in enumerate(_row_bits(_quantised(pixels[at : at + 8 * 16], quality), dc, ac)):
            number = first + at // 8 + k
            out.append(data.replace(b"\xff", b"\xff\x00"))
            if not last or at + 8 * (k + 1) < len(pixels):
                out.append(bytes([0xFF, 0xD0 + number % 8]))
    return b"".join(out)


def encode(pixels: np.ndarray, quality: int = QUALITY) -> bytes:
    return header(pixels.shape[1], pixels.shape[0], quality) + encode_rows(pixels, quality=quality) + END


def is_jpeg(data: bytes) -> bool:
    return data[:3] == b"\xff\xd8\xff"


def _parts(data: bytes):
    """(marker, its data, where it ends) up to the end; the data of a scan's header is followed by coded bytes."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where there should be one")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            return
        if mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2 or at + 2 + size > len(data):
            raise ValueError("a marker reaches beyond the end")
        at = yield mark, data[at + 4 : at + 2 + size], at + 2 + size


def size_of(data: bytes) -> tuple[int, int]:
    """(width, height) by the header alone, of any kind of JPEG."""
    parts = _parts(data) if is_jpeg(data) else iter(())
    send = None
    while True:
        try:
            mark, body, end = parts.send(send) if send else next(parts)
        except StopIteration:
            raise ValueError("no frame") from None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", body, 1)
            return width, height
        send = end


@functools.lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """By the next 16 bits: the bits of the code and its symbol, as bits << 8 | symbol; 0 for no code."""
    out, code, at = np.zeros(65536, np.int64), 0, 0
    for bits, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            out[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbol
            code += 1
        at += count
        code <<= 1
    return out.tolist()


class _Component:
    def __init__(self, name: int, across: int, down: int, table: int):
        self.name, self.across, self.down, self.table = name, across, down, table
        self.places: list[int] = []
        self.values: list[int] = []


def _scan(segment: bytes, blocks: list[tuple[_Component, int]], dc: dict, ac: dict) -> None:
    """Decodes a restart interval: the coefficients of blocks (component, number of the block), in order."""
    raw = np.frombuffer(segment.replace(b"\xff\x00", b"\xff") + b"\xff" * 8, np.uint8).astype(np.int64)
    ahead = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tolist()
    most, p, last = (len(raw) - 8) * 8, 0, {}
    try:
        for c, number in blocks:
            first, rest = dc[c.name], ac[c.name]
            found = first[ahead[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
            if not found:
                raise ValueError("no such code")
            p += found >> 8
            size = found & 255
            value = 0
            if size:
                value = ahead[p >> 3] >> (32 - (p & 7) - size) & ((1 << size) - 1)
                p += size
                if value < 1 << (size - 1):
                    value -= (1 << size) - 1
            last[c.name] = value = last.get(c.name, 0) + value
            base = number * 64
            c.places.append(base)
            c.values.append(value)
            k = 1
            while k < 64:
                found = rest[ahead[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
                if not found:
                    raise ValueError("no such code")
                p += found >> 8
                size = found & 15
                if not size:
                    if found & 0xF0 != 0xF0:
                        break
                    k += 16
                    continue
                k += found >> 4 & 15
                value = ahead[p >> 3] >> (32 - (p & 7) - size) & ((1 << size) - 1)
                p += size
                if value < 1 << (size - 1):
                    value -= (1 << size) - 1
                if k > 63:
                    raise ValueError("a run reaches beyond its block")
                c.places.append(base + k)
                c.values.append(value)
                k += 1
    except IndexError:
        raise ValueError("the coded bits end too early") from None
    if p > most + 7:
        raise ValueError("the coded bits end too early")


def _spread(plane: np.ndarray, most: int, own: int, size: int) -> np.ndarray:
    """Rows of a plane at a lower resolution as `size` rows: between neighbours where they are half as many, else repeated."""
    if most == own:
        return plane[:size]
    if most != 2 * own:
        return plane[np.arange(size) * own // most]
    near = np.arange(size) // 2
    far = np.clip(near + np.where(np.arange(size) % 2, 1, -1), 0, len(plane) - 1)
    return 0.75 * plane[near] + 0.25 * plane[far]


def decode(data: bytes) -> np.ndarray:
    """The 8-bit RGB pixels (height, width, 3) of a sequential JPEG of one or three components, of any sampling.

    Progressive, arithmetic-coded, lossless, 12-bit and four-component files raise ValueError, as damaged ones do. Colours
    at half the resolution are mixed from the two nearest samples either way.
    """
    try:
        return _decode(data)
    except (struct.error, KeyError, IndexError) as e:
        raise ValueError(f"not a sequential JPEG: {e!r}") from None


def _decode(data: bytes) -> np.ndarray:
    if not is_jpeg(data):
        raise ValueError("not a JPEG")
    parts, send = _parts(data), None
    tables, codes, interval, frame, own, plain_rgb = {}, {}, 0, None, [], False
    while True:
        try:
            mark, body, end = parts.send(send) if send else next(parts)
        except StopIteration:
            break
        send = end
        if mark == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                table = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                tables[number], body = table, body[65 + 64 * wide :]
                if len(table) != 64:
                    raise ValueError("a table is cut off")
        elif mark == 0xC4:
            while body:
                count = sum(body[1:17])
                codes[body[0]], body = _lookup(body[1:17], body[17 : 17 + count]), body[17 + count :]
        elif mark == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            plain_rgb = body[11] == 0
        elif mark in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or not width or not height or width * height > LARGEST:
                raise ValueError(f"{n} components of {depth} bits, {width} x {height}, can't be read")
            frame = [_Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if any(not (0 < c.across < 5 and 0 < c.down < 5) for c in frame):
                raise ValueError("no such sampling")
            wide, high = max(c.across for c in frame), max(c.down for c in frame)
            nx, ny = -(-width // (8 * wide)), -(-height // (8 * high))
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8:
            raise ValueError("only sequential JPEGs of prefix codes can be read")
        elif mark == 0xDA:
            if frame is None:
                raise ValueError("a scan before its frame")
            by_name = {c.name: c for c in frame}
            own = [(by_name[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(body[0])]
            stop = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, end)
            send = stop.start() if stop else len(data)
            if len(own) == 1:  # a scan of one component has its own blocks alone
                c = own[0][0]
                across, down = -(-(-(-width * c.across // wide)) // 8), -(-(-(-height * c.down // high)) // 8)
                units = [[(c, y * nx * c.across + x)] for y in range(down) for x in range(across)]
            else:
                units = [[(c, (y * c.down + v) * nx * c.across + x * c.across + u) for c, _ in own for v in range(c.down) for u in range(c.across)] for y in range(ny) for x in range(nx)]
            dc, ac = {c.name: codes[t >> 4] for c, t in own}, {c.name: codes[0x10 | t & 15] for c, t in own}
            segments = re.split(rb"\xff+[\xd0-\xd7]", data[end:send])
            step = interval or len(units)
            if len(segments) < -(-len(units) // step):
                raise ValueError("restart intervals are missing")
            for k, segment in zip(range(0, len(units), step), segments):
                _scan(segment, [b for unit in units[k : k + step] for b in unit], dc, ac)
    if frame is None or not any(c.places for c in frame):
        raise ValueError("no image")
    planes = []
    for c in frame:
        flat = np.zeros(ny * c.down * nx * c.across * 64)
        flat[np.array(c.places, np.int64)] = c.values
        found = np.zeros((len(flat) // 64, 64))
        found[:, ZIGZAG] = flat.reshape(-1, 64) * tables[c.table]
        samples = np.clip(np.rint(COSINES.T @ found.reshape(-1, 8, 8) @ COSINES + 128), 0, 255)
        plane = samples.reshape(ny * c.down, nx * c.across, 8, 8).transpose(0, 2, 1, 3).reshape(ny * c.down * 8, nx * c.across * 8)
        plane = plane[: -(-height * c.down // high), : -(-width * c.across // wide)]
        planes.append(np.rint(_spread(_spread(plane, high, c.down, height).T, wide, c.across, width).T))
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    if plain_rgb:
        return np.stack(planes, axis=2).astype(np.uint8)
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.rint(np.stack((y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b), axis=2)), 0, 255).astype(np.uint8)
