"""Lossless WebP: a decoder for media columns, an encoder, and payload round trips.

decode() reads the container and the whole lossless bitstream: prefix codes (simple and normal, also by
meta blocks), back-references, colour cache, and the predictor, cross-colour, subtract-green and palette
transforms, and gives an array of 8-bit samples. An image of one group of codes without a cache is read by arrays:
the code word at every bit of a stretch of the stream is looked up at once, the words that count are found by
following the chain of their ends, and literals and back-references are then put in place. Other images are read
symbol by symbol.

encode_bytes(), which payloads go through, writes one byte to a pixel: back-references to earlier equal stretches,
prefix codes fitted to what is left, and for up to 16 different bytes a palette, several pixels in one. encode() writes RGB or RGBA samples with codes of one width, on request after subtract-green, cross-colour or
predictor transforms. Text gains nothing from these or a colour cache: payload files have none of them.

Defined results: a null text is an empty payload, padded like any other to one block. Equal payloads give
equal files and features. Rows are independent. A file that isn't lossless WebP raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

UNIT = 576
#: Fixed values of the format: the order in which code length code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (x, y) of the near distances 1 to 120.
# fmt: off
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
# fmt: on
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)


class Bits:
    """Least significant bit first."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held, self.n = raw, 0, 0, 0
        self.end = 8 * len(raw)

    @property
    def position(self) -> int:
        return 8 * self.at - self.n

    def seek(self, bit: int) -> None:
        self.at, self.held, self.n = bit // 8, 0, 0
        if bit % 8:
            self.take(bit % 8)

    def fill(self) -> None:
        part = self.raw[self.at : self.at + 8]
        self.held |= int.from_bytes(part, "little") << self.n
        self.at += len(part)
        self.n += 8 * len(part)

    def take(self, n: int) -> int:
        if self.n < n:
            self.fill()
            if self.n < n:
                raise ValueError("the stream ends too early")
        v = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return v


@lru_cache(64)
def _reversal(width: int) -> np.ndarray:
    """Of every number of `width` bits the number with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


class Code:
    """A canonical prefix code, read through a table over as many bits as its longest word."""

    def __init__(self, lengths: tuple[int, ...]):
        self.lengths = np.array(lengths, np.int64)
        used = np.flatnonzero(self.lengths)
        if len(used) < 2:
            self.only = int(used[0]) if len(used) else 0
            self.width, self.symbols, self.sizes = 0, np.array([self.only]), np.zeros(1, np.int64)
        else:
            self.only, self.width = None, int(self.lengths.max())
            used = used[np.argsort(self.lengths[used], kind="stable")]
            spans = 1 << (self.width - self.lengths[used])
            if (total := int(spans.sum())) != 1 << self.width:
                raise ValueError("a prefix code " + ("is incomplete" if total < 1 << self.width else "has too many words"))
            turned = _reversal(self.width)
            self.symbols, self.sizes = np.repeat(used, spans)[turned], np.repeat(self.lengths[used], spans)[turned]
        self._pairs: list[tuple[int, int]] | None = None

    def read(self, bits: Bits) -> int:
        if self._pairs is None:
            self._pairs = list(zip(self.symbols.tolist(), self.sizes.tolist()))
        if bits.n < self.width:
            bits.fill()
        s, n = self._pairs[bits.held & ((1 << self.width) - 1)]
        if n > bits.n:
            raise ValueError("the stream ends too early")
        bits.held >>= n
        bits.n -= n
        return s

    def uniform(self) -> int | None:
        """The length of all words, if they share one."""
        return self.width if (self.sizes == self.width).all() else None


code_of = lru_cache(256)(Code)


def read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        symbols = [bits.take(8 if wide else 1)] + ([bits.take(8)] if two else [])
        for s in symbols:
            if s >= size:
                raise ValueError("a symbol is out of range")
            lengths[s] = 1
        return code_of(tuple(lengths))
    n = 4 + bits.take(4)
    of_lengths = [0] * 19
    for k in range(n):
        of_lengths[LENGTH_ORDER[k]] = bits.take(3)
    reader = code_of(tuple(of_lengths))
    left = size
    if bits.take(1):
        left = 2 + bits.take(2 + 2 * bits.take(3))
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = reader.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
        else:
            value = last if s == 16 else 0
            for _ in range(3 + bits.take(2) if s == 16 else 3 + bits.take(3) if s == 17 else 11 + bits.take(7)):
                if at >= size:
                    raise ValueError("too many code lengths")
                lengths[at] = value
                at += 1
    return code_of(tuple(lengths))


def length_value(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels as u32, in order."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, meta, meta_bits = 1, None, 0
    if main and bits.take(1):
        meta_bits = bits.take(3) + 2
        across = -(-width >> meta_bits)
        meta = read_pixels(bits, across, -(-height >> meta_bits), False) >> 8 & 0xFFFF
        groups = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    sizes = (256 + 24 + cache_size, 256, 256, 256, 40)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache_size:
        fast = _fixed_width(bits, codes[0], total)
        return _by_arrays(bits, codes[0], total, width) if fast is None else fast
    out: list[int] = []
    cache = [0] * cache_size
    shift = 32 - cache_bits
    put = out.append
    chosen, across = codes[0], -(-width >> meta_bits)
    read = Code.read
    while len(out) < total:
        if meta is not None:
            at = len(out)
            chosen = codes[meta[(at // width >> meta_bits) * across + (at % width >> meta_bits)]]
        s = read(chosen[GREEN], bits)
        if s < 256:
            r, b, a = read(chosen[RED], bits), read(chosen[BLUE], bits), read(chosen[ALPHA], bits)
            p = a << 24 | r << 16 | s << 8 | b
            put(p)
            if cache_size:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
        elif s < 280:
            n = length_value(s - 256, bits)
            d = length_value(read(chosen[DISTANCE], bits), bits)
            if d <= 120:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            else:
                d -= 120
            if d > len(out) or len(out) + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                p = out[-d]
                put(p)
                if cache_size:
                    cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
        else:
            p = cache[s - 280]
            put(p)
            cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
    return np.array(out, np.uint32)


def _fixed_width(bits: Bits, codes: list[Code], total: int) -> np.ndarray | None:
    """All pixels at once, if every word of a channel has the same length and green has literals only."""
    widths = [c.uniform() for c in codes[:4]]
    if None in widths or codes[GREEN].lengths[256:].any():
        return None
    start, each = bits.position, sum(widths)
    if start + each * total > bits.end:
        raise ValueError("the stream ends too early")
    argb = [0, 0, 0, 0]
    skip = 0
    if each:
        raw = np.frombuffer(bits.raw, np.uint8, -(-(start % 8 + each * total) // 8), start // 8)
        if start % 8:
            low = raw >> (start % 8)
            low[:-1] |= raw[1:] << (8 - start % 8)
            raw = low
        if each % 8 == 0:
            words = raw[: each // 8 * total].reshape(total, each // 8)
        else:
            flat = np.unpackbits(raw, count=each * total, bitorder="little").reshape(total, each)
    for k in range(4):
        table = codes[k].symbols.astype(np.uint8)
        w = widths[k]
        if not w:
            argb[k] = np.full(total, table[0], np.uint32)
        elif each % 8 == 0 and w == 8 and skip % 8 == 0:
            argb[k] = table[words[:, skip // 8]].astype(np.uint32)
        else:
            if each % 8 == 0:
                flat = np.unpackbits(words, axis=1, bitorder="little")
            at = np.packbits(flat[:, skip : skip + w], axis=1, bitorder="little")[:, 0]
            argb[k] = table[at].astype(np.uint32)
        skip += w
    bits.seek(start + each * total)
    g, r, b, a = argb
    return a << 24 | r << 16 | g << 8 | b


#: Bits of a stream that are looked at in one go: the bound of what reading takes beside the image.
STRETCH = 1 << 20
_EIGHT = np.arange(8, dtype=np.uint64)


def _prefixed(prefix: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """length_value() of prefixes whose extra bits stand at the bits `at`, and where these end."""
    extra = np.maximum(prefix - 2, 0) >> 1
    more = (words[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64) & ((1 << extra) - 1)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + more + 1), at + extra


def _by_arrays(bits: Bits, codes: list[Code], total: int, width: int) -> np.ndarray:
    """The pixels of an image of one group of codes without a cache."""
    green, dist = codes[GREEN], codes[DISTANCE]
    others = [(c, shift) for c, shift in zip(codes[1:4], (16, 0, 24))]
    constant = sum(c.only << shift for c, shift in others if c.width == 0)
    table = green.symbols | green.sizes << 16
    padded_ = bits.raw + bytes(64)
    every = np.ndarray((len(padded_) - 8,), "<u8", padded_, 0, (1,))  # the 64 bits from each byte on
    out = np.empty(total, np.uint32)
    done, at = 0, bits.position
    while done < total:
        if at >= bits.end and (green.width or any(c.width for c, _ in others)):
            raise ValueError("the stream ends too early")
        base = at >> 3
        n = min(STRETCH >> 3, len(bits.raw) - base) + 1
        words = every[base : base + n + 40]
        size = 8 * n
        found = table[(words[:n, None] >> _EIGHT & np.uint64((1 << green.width) - 1)).view(np.int64).ravel()]
        symbol = found & 0xFFFF
        end = np.arange(size) + (found >> 16)
        refs = np.flatnonzero(symbol >= 256)
        for c, _ in others:
            if c.width:
                plain = np.flatnonzero(symbol < 256)
                e = end[plain]
                end[plain] = e + c.sizes[(words[e >> 3] >> (e & 7).astype(np.uint64)).astype(np.int64) & ((1 << c.width) - 1)]
        if len(refs):
            if (symbol[refs] >= 280).any():
                raise ValueError("a symbol of a cache that there is not")
            length, e = _prefixed(symbol[refs] - 256, end[refs], words)
            k = (words[e >> 3] >> (e & 7).astype(np.uint64)).astype(np.int64) & ((1 << dist.width) - 1)
            back, e = _prefixed(dist.symbols[k], e + dist.sizes[k], words)
            end[refs] = e
        # Every eighth token by steps of eight, the others from these.
        step = np.append(np.minimum(end, size), size)
        eight = step[step]
        eight = eight[eight]
        eight = eight[eight]
        p, firsts = at - 8 * base, []
        least = total - done
        while p < size and 8 * len(firsts) < least:
            firsts.append(p)
            p = eight.item(p)
        chain = [np.array(firsts)]
        for _ in range(7):
            chain.append(step[chain[-1]])
        tokens = np.stack(chain, axis=1).ravel()
        tokens = tokens[tokens < size]
        made = np.ones(len(tokens), np.int64)
        s = symbol[tokens]
        is_ref = s >= 256
        if len(refs):
            which = np.searchsorted(refs, tokens[is_ref])
            made[is_ref] = length[which]
        upto = np.cumsum(made)
        m = min(int(np.searchsorted(upto, least)) + 1, len(tokens))
        tokens, made, s, is_ref = tokens[:m], made[:m], s[:m], is_ref[:m]
        if done + int(upto[m - 1]) > total:
            raise ValueError("a back-reference leaves the image")
        place = done + upto[:m] - made
        lit = ~is_ref
        pixels_ = (s[lit] << 8 | constant).astype(np.uint32)
        e = tokens[lit] + (found[tokens[lit]] >> 16)
        for c, shift in others:
            if c.width:
                k = (words[e >> 3] >> (e & 7).astype(np.uint64)).astype(np.int64) & ((1 << c.width) - 1)
                pixels_ |= (c.symbols[k] << shift).astype(np.uint32)
                e = e + c.sizes[k]
        out[place[lit]] = pixels_
        if len(refs):
            which = which[: int(is_ref.sum())]
            for o, count, d in zip(place[is_ref].tolist(), length[which].tolist(), back[which].tolist()):
                if d <= 120:
                    x, y = NEAR[d - 1]
                    d = max(1, x + y * width)
                else:
                    d -= 120
                if d > o:
                    raise ValueError("a back-reference leaves the image")
                if d >= count:
                    out[o : o + count] = out[o - d : o - d + count]
                else:
                    out[o : o + count] = np.resize(out[o - d : o], count)
        done += int(upto[m - 1])
        at = 8 * base + int(end[tokens[-1]])
        if at > bits.end:
            raise ValueError("the stream ends too early")
    bits.seek(at)
    return out


def _channels(p: np.ndarray) -> np.ndarray:
    """(n, 4) samples in the order blue, green, red, alpha."""
    return np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(-1, 4)


def _average(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b)]


def predict(mode: int, left, top, top_left, top_right) -> list[int]:
    """The predicted pixel, as a list of four samples."""
    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode < 5:
        return list((left, top, top_right, top_left)[mode - 1])
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode < 11:
        if mode == 10:
            return _average(_average(left, top_left), _average(top, top_right))
        return _average(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left))
        return list(left if to_left < to_top else top)
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, top_left)]
    half = _average(left, top)
    return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(half, top_left)]


def _walk_predictor(p: np.ndarray, modes: np.ndarray, size_bits: int, width: int, height: int, undo: bool) -> np.ndarray:
    """Add (or, for the encoder, subtract) predictions, pixel by pixel in order."""
    given = _channels(p).tolist()
    real = given if not undo else []
    out, across = [], -(-width >> size_bits)
    for at in range(width * height):
        y, x = divmod(at, width)
        if at == 0:
            guess = [0, 0, 0, 255]
        elif y == 0:
            guess = real[at - 1]
        elif x == 0:
            guess = real[at - width]
        else:
            mode = int(modes[(y >> size_bits) * across + (x >> size_bits)])
            guess = predict(mode, real[at - 1], real[at - width], real[at - width - 1], real[at - width + 1])
        sign = 1 if undo else -1
        value = [(v + sign * g) & 255 for v, g in zip(given[at], guess)]
        out.append(value)
        if undo:
            real.append(value)
    return np.array(out, np.uint8).reshape(-1, 4).view("<u4").ravel()


def _cross(p: np.ndarray, elements: np.ndarray, size_bits: int, width: int, height: int, undo: bool) -> np.ndarray:
    across = -(-width >> size_bits)
    y, x = np.divmod(np.arange(width * height), width)
    e = _channels(elements)[(y >> size_bits) * across + (x >> size_bits)].view(np.int8).astype(np.int32)
    c = _channels(p).copy()
    green_to_red, green_to_blue, red_to_blue = e[:, 0], e[:, 1], e[:, 2]
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int32)
    green, sign = signed(c[:, 1]), 1 if undo else -1
    before = signed(c[:, 2])
    red = c[:, 2].astype(np.int32) + sign * (green_to_red * green >> 5)
    blue = c[:, 0].astype(np.int32) + sign * (green_to_blue * green >> 5)
    blue += sign * (red_to_blue * (signed(red & 255) if undo else before) >> 5)
    c[:, 2], c[:, 0] = red & 255, blue & 255
    return c.view("<u4").ravel()


def _green(p: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(p).copy()
    c[:, 0] += np.uint8(sign & 255) * c[:, 1]
    c[:, 2] += np.uint8(sign & 255) * c[:, 1]
    return c.view("<u4").ravel()


def _unpack_palette(p: np.ndarray, colors: np.ndarray, bundle: int, width: int, height: int) -> np.ndarray:
    at = (p >> 8 & 0xFF).astype(np.int64)
    if bundle:
        each, step = 8 >> bundle, 1 << bundle
        at = (at[:, None] >> (each * np.arange(step))) & ((1 << each) - 1)
        at = at.reshape(height, -1)[:, :width].ravel()
    return np.append(colors, np.zeros(256, np.uint32))[at].astype(np.uint32)


def decode_argb(stream: bytes) -> tuple[np.ndarray, int, int]:
    """Pixels (u32, ARGB), width and height of a lossless bitstream."""
    bits = Bits(stream)
    if bits.take(8) != 0x2F:
        raise ValueError("not a lossless WebP stream")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    full, todo, seen = width, [], set()
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            size_bits = bits.take(3) + 2
            data = read_pixels(bits, -(-width >> size_bits), -(-height >> size_bits), False)
            todo.append((kind, width, data, size_bits))
        elif kind == PALETTE:
            n = bits.take(8) + 1
            deltas = _channels(read_pixels(bits, n, 1, False))
            colors = np.cumsum(deltas, axis=0, dtype=np.uint8).view("<u4").ravel()
            bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, width, colors, bundle))
            width = -(-width >> bundle)
        else:
            todo.append((kind, width, None, 0))
    p = read_pixels(bits, width, height, True)
    for kind, w, data, k in reversed(todo):
        if kind == PREDICTOR:
            p = _walk_predictor(p, data >> 8 & 0xFF, k, w, height, True)
        elif kind == CROSS_COLOR:
            p = _cross(p, data, k, w, height, True)
        elif kind == SUBTRACT_GREEN:
            p = _green(p, 1)
        else:
            p = _unpack_palette(p, data, k, w, height)
    return p, full, height


def bitstream(file: bytes) -> bytes:
    """The lossless bitstream in a WebP file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(file):
        name, n = file[at : at + 4], int.from_bytes(file[at + 4 : at + 8], "little")
        if name == b"VP8L":
            return file[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no lossless bitstream")


def decode(file: bytes) -> np.ndarray:
    """The samples of a file: (height, width, 4), red, green, blue, alpha."""
    p, width, height = decode_argb(bitstream(file))
    return _channels(p)[:, [2, 1, 0, 3]].reshape(height, width, 4)


class Out:
    """A bit sink, least significant bit first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def followed_by(self, tail: np.ndarray) -> Out:
        """A sink that holds these bits and those of tail."""
        new = Out()
        new.value, new.n = int.from_bytes(self.bytes_with(tail), "little"), self.n + len(tail)
        return new

    def bytes_with(self, tail: np.ndarray | None) -> bytes:
        """All bits, followed by those of tail (an array of 0 and 1)."""
        if tail is None:
            return self.value.to_bytes(-(-self.n // 8), "little")
        head = np.unpackbits(np.frombuffer(self.value.to_bytes(-(-self.n // 8), "little"), np.uint8), bitorder="little")
        return np.packbits(np.concatenate([head[: self.n], tail]), bitorder="little").tobytes()


def _put_fixed(out: Out, values: np.ndarray, size: int = 256) -> tuple[np.ndarray, int]:
    """Write a code whose words are equally long and cover the values; returns each value's word and the width."""
    present = np.flatnonzero(np.bincount(values, minlength=256))
    words = np.zeros(256, np.uint8)
    if len(present) == 1:
        out.put(0b101, 3)  # simple, one symbol, eight bits
        out.put(int(present[0]), 8)
        return words, 0
    width = max(1, int(len(present) - 1).bit_length())
    member = np.zeros(256, bool)
    member[present] = True
    member[np.flatnonzero(~member)[: (1 << width) - len(present)]] = True
    symbols = np.flatnonzero(member)
    reverse = np.packbits(np.unpackbits(np.arange(1 << width, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1)[:, 0]
    words[symbols] = reverse >> (8 - width)
    _put_code(out, np.append(np.where(member, width, 0), np.zeros(size - 256, np.int64)))
    return words, width


def _fixed_image(out: Out, p: np.ndarray) -> np.ndarray:
    """Write codes for the pixels; returns their bits."""
    c = _channels(p)
    parts, widths = [], []
    for k in (1, 2, 0, 3):
        words, width = _put_fixed(out, c[:, k], 280 if k == 1 else 256)
        if width:
            bits = np.unpackbits(words[c[:, k]][:, None], axis=1, count=width, bitorder="little")
            parts.append(bits)
        widths.append(width)
    out.put(0b0001, 4)  # distance: simple, one symbol, one bit, zero
    return np.concatenate(parts, axis=1).ravel() if parts else np.zeros(0, np.uint8)


def encode(samples: np.ndarray, transforms: tuple[str, ...] = (), predictor: int = 2, elements: tuple[int, int, int] = (37, 200, 91)) -> bytes:
    """A file of (height, width, 3 or 4) samples. transforms: "subtract_green",
    "predictor", "cross_color" with `elements` (green to red, green to blue, red to blue; bytes); in the order given."""
    height, width, n = samples.shape
    c = np.full((height * width, 4), 255, np.uint8)
    c[:, [2, 1, 0, 3][:n]] = samples.reshape(-1, n)
    p = c.view("<u4").ravel()
    out = Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(n == 4), 1)
    out.put(0, 3)
    for name in transforms:
        out.put(1, 1)
        if name == "subtract_green":
            out.put(SUBTRACT_GREEN, 2)
            p = _green(p, -1)
            continue
        blocks = (-(-width >> 9)) * (-(-height >> 9))
        if name == "cross_color":
            out.put(CROSS_COLOR, 2)
            out.put(7, 3)
            each = np.full(blocks, 0xFF000000 | elements[2] << 16 | elements[1] << 8 | elements[0], np.uint32)
            out.put(0, 1)
            _fixed_image(out, each)  # one value: no bits
            p = _cross(p, each, 9, width, height, False)
        else:
            out.put(PREDICTOR, 2)
            out.put(7, 3)
            modes = np.full(blocks, 0xFF000000 | predictor << 8, np.uint32)
            out.put(0, 1)
            _fixed_image(out, modes)  # one value: no bits
            p = _walk_predictor(p, np.full(blocks, predictor), 9, width, height, False)
    out.put(0, 3)  # no more transforms, no cache, one group of codes
    stream = out.bytes_with(_fixed_image(out, p))
    return _file(stream)


def code_lengths(counts: np.ndarray, limit: int = 12) -> np.ndarray:
    """Lengths of a complete prefix code for symbols that occur so often: the bits of information, rounded up, then
    shortened, frequent symbols first, while there is room. A symbol alone has length 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    used = used[np.argsort(-counts[used], kind="stable")]
    n = np.clip(np.ceil(np.log2(counts[used].sum() / counts[used])).astype(np.int64), 1, limit).tolist()
    room = (1 << limit) - sum(1 << (limit - x) for x in n)
    k = len(n) - 1
    while room < 0:  # the rarest symbols that aren't at the limit give way
        if n[k] < limit:
            n[k] += 1
            room += 1 << (limit - n[k])
        else:
            k -= 1
    while room:
        for k, x in enumerate(n):
            if 1 << (limit - x) <= room:
                n[k] = x - 1
                room -= 1 << (limit - x)
    out[used] = n
    return out


def code_words(lengths: np.ndarray) -> np.ndarray:
    """The canonical code's words, first bit lowest."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    width = int(lengths.max())
    first = np.cumsum(1 << (width - lengths[used])) - (1 << (width - lengths[used]))
    words = np.zeros(len(lengths), np.int64)
    words[used] = _reversal(width)[first]
    return words


def _put_code(out: Out, lengths: np.ndarray) -> None:
    """Write a code of lengths up to 13: one symbol alone as a simple code; else each length, and runs of zeros, in
    four bits."""
    used = np.flatnonzero(lengths)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        out.put(0b101, 3)
        out.put(int(used[0]) if len(used) else 0, 8)
        return
    fixed = [*range(14), 17, 18]  # sixteen symbols of four bits
    out.put(0, 1)
    out.put(15, 4)
    for s in LENGTH_ORDER:
        out.put(4 if s in fixed else 0, 3)
    out.put(0, 1)
    turned = _reversal(4).tolist()
    value, n, after = 0, 0, 0
    for at, x in zip([*used.tolist(), len(lengths)], [*lengths[used].tolist(), None]):
        gap, after = at - after, at + 1
        while gap:
            run = min(gap, 138)
            if run > 10:
                value |= (turned[15] | (run - 11) << 4) << n
                n += 11
            elif run > 2:
                value |= (turned[14] | (run - 3) << 4) << n
                n += 7
            else:
                value |= turned[0] << n
                n, run = n + 4, 1
            gap -= run
        if x:
            value |= turned[x] << n
            n += 4
    out.put(value, n)


def repeats(a: np.ndarray, least: int = 8, farthest: int = (1 << 20) - 120, longest: int = 4096) -> list[tuple[int, int, int]]:
    """(start, length, distance) of stretches of bytes equal to earlier ones, in order, without overlap."""
    n = len(a) - least + 1
    if n < 2:
        return []
    buffer = a.tobytes() + bytes(8)
    key = np.ndarray((n,), "<u8", buffer, 0, (1,)).astype(np.uint64)
    with np.errstate(over="ignore"):
        short = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(short, kind="stable")
    before = np.full(n, -1)
    before[order[1:]] = np.where(short[order[1:]] == short[order[:-1]], order[:-1], -1)
    at = np.flatnonzero(before >= 0)
    at = at[key[at] == key[before[at]]]
    far = at - before[at]
    at, far = at[far <= farthest], far[far <= farthest]
    if not len(at):
        return []
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (far[1:] != far[:-1])))
    ends = at[np.append(new[1:], len(at)) - 1] + least
    out, free = [], 0
    for start, end, d in zip(at[new].tolist(), ends.tolist(), far[new].tolist()):
        start = max(start, free)
        while end - start >= least:
            size = min(end - start, longest)
            out.append((start, size, d))
            start = free = start + size
    return out


def _prefix_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and their number, of values from 1 on."""
    x = v - 1
    high = np.floor(np.log2(np.maximum(x, 1))).astype(np.int64)
    few = x < 4
    extra = np.where(few, 0, high - 1)
    return np.where(few, x, 2 * high + (x >> np.maximum(high - 1, 0) & 1)), x & ((1 << extra) - 1), extra


def _fitted_image(out: Out, green: np.ndarray, alpha: int) -> np.ndarray:
    """Write codes for pixels that differ in green only, and no cache or meta blocks; returns the bits of the pixels."""
    found = repeats(green)
    start, size, far = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    own = np.ones(len(green), bool)
    if found:
        inside = np.zeros(len(green) + 1, np.int64)
        inside[start] += 1
        inside[start + size] -= 1
        own = np.cumsum(inside[:-1]) == 0
        own[start] = True
    symbol = green.astype(np.int64)
    length, more, n_more = _prefix_of(size)
    distance, beyond, n_beyond = _prefix_of(far + 120)
    symbol[start] = 256 + length
    tokens = symbol[own]
    of_green = code_lengths(np.bincount(tokens, minlength=280))
    of_distance = code_lengths(np.bincount(distance, minlength=40))
    out.put(0, 1)  # no cache
    out.put(0, 1)  # one group
    _put_code(out, of_green)
    for x in (0, 0, alpha):
        out.put(0b101, 3)
        out.put(x, 8)
    _put_code(out, of_distance)
    if (of_green > 0).sum() < 2:
        of_green = np.zeros(280, np.int64)
    word, n = code_words(of_green)[tokens] if of_green.any() else np.zeros(len(tokens), np.int64), of_green[tokens]
    if found:
        single = (of_distance > 0).sum() < 2
        n_far = np.zeros(len(distance), np.int64) if single else of_distance[distance]
        far_word = np.zeros(len(distance), np.int64) if single else code_words(of_distance)[distance]
        at = np.cumsum(own)[start] - 1
        full, k = word[at], n[at]
        for value, count in ((more, n_more), (far_word, n_far), (beyond, n_beyond)):
            full = full | value << k
            k = k + count
        word[at], n[at] = full, k
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.uint8)
    within = np.arange(ends[-1]) - np.repeat(ends - n, n)
    return (np.repeat(word, n) >> within & 1).astype(np.uint8)


def _palette_image(out: Out, green: np.ndarray) -> np.ndarray:
    """Write codes for differences of colours, green ones and an alpha of 255 that the first colour has; returns the
    bits of the pixels."""
    words, width = _put_fixed(out, green, 280)
    for _ in range(2):
        out.put(0b101, 3)  # simple, one symbol, eight bits: zero
        out.put(0, 8)
    out.put(0b0011, 4)  # simple, two symbols, the first one bit: zero and 255
    out.put(255, 8)
    out.put(0b0001, 4)  # distance: simple, one symbol, one bit, zero
    bits = np.zeros((len(green), width + 1), np.uint8)
    bits[:, :width] = words[green][:, None] >> np.arange(width, dtype=np.uint8) & 1
    bits[0, width] = 1
    return bits.ravel()


def encode_bytes(samples: np.ndarray) -> bytes:
    """A file of (height, width) bytes, which are its green samples; red and blue are 0, alpha is 255.

    With up to 16 different bytes, a palette puts several pixels into one; with more, it would only add to the file.
    """
    height, width = samples.shape
    out = Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)
    present = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    alpha = 255
    if len(present) <= 16:
        rank = np.zeros(256, np.uint8)
        rank[present] = np.arange(len(present))
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(present) - 1, 8)
        out.put(0, 1)  # no cache
        out = out.followed_by(_palette_image(out, np.diff(present, prepend=0)))
        bundle = 3 if len(present) <= 2 else 2 if len(present) <= 4 else 1
        step, each = 1 << bundle, 8 >> bundle
        wide = np.zeros((height, -(-width // step) * step), np.uint8)
        wide[:, :width] = rank[samples]
        samples = np.bitwise_or.reduce(wide.reshape(height, -1, step) << (each * np.arange(step, dtype=np.uint8)), axis=2).astype(np.uint8)
        alpha = 0
    out.put(0, 1)  # no more transforms
    return _file(out.bytes_with(_fitted_image(out, samples.ravel(), alpha)))


def _file(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    """raw with bytes 255 appended up to a positive multiple of unit."""
    return raw + b"\xff" * (-len(raw) % unit or (0 if raw else unit))


#: Bytes of the largest image of one byte to a pixel whose width is a multiple of the unit.
ONE_IMAGE = 28 * UNIT * 16384


def payload_file(payload: bytes) -> bytes:
    """A file whose green samples, in order, begin with the payload; above ONE_IMAGE its red, green and blue ones."""
    if len(payload) <= ONE_IMAGE:
        width = UNIT * max(1, -(-len(payload) // (UNIT * 16384)))
        height = -(-len(payload) // width)
        return encode_bytes(np.frombuffer(payload.ljust(width * height, b"\xff"), np.uint8).reshape(height, width))
    pixels = -(-len(payload) // 3)
    width = 192 * max(1, -(-pixels // (192 * 16384)))
    height = -(-pixels // width)
    samples = np.frombuffer(payload.ljust(3 * width * height, b"\xff"), np.uint8)
    return encode(samples.reshape(height, width, 3))


def read_payload(file: bytes, n: int) -> bytes:
    if n <= ONE_IMAGE:
        pixels_, _, _ = decode_argb(bitstream(file))
        return (pixels_ >> 8).astype(np.uint8).tobytes()[:n]
    return decode(file)[:, :, :3].tobytes()[:n]


def feature(samples: np.ndarray) -> str:
    """Means of sixteen equal stretches of the samples, whose number sixteen divides, and their spread, in hex."""
    means = samples.reshape(16, -1).mean(axis=1).astype(int).tolist()
    return bytes([*means, int(samples.std())]).hex()


def store(docs: DataFrame, column: str = "text") -> DataFrame:
    """(row id, file) is left to the caller: docs with `column` replaced by a lossless WebP file of its bytes."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == column else f for f in docs.schema])

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(column)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                files = [payload_file(padded((t or "").encode())) for t in part.column(at).to_pylist()]
                columns = [pa.array(files, pa.binary()) if k == at else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def pixels(media: DataFrame, column: str = "file") -> DataFrame:
    """media with width, height and rgba (samples, row by row) of the files in `column`; null for a null file."""
    from pyspark.sql import types as T

    new = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgba", T.BinaryType())]
    taken = {c.lower() for c in media.columns}
    if clash := taken & {f.name for f in new}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    schema = T.StructType([*media.schema.fields, *new])

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(column)
            for lo in range(batch.num_rows):
                part = batch.slice(lo, 1)
                file = part.column(at)[0].as_py()
                image = None if file is None else decode(file)
                values = [None] * 3 if image is None else [image.shape[1], image.shape[0], image.tobytes()]
                columns = [pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)

    return media.mapInArrow(run, schema)


REPORT = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def media_report(docs: DataFrame) -> DataFrame:
    """Store every text as a file, read the file back, and describe what was read."""

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                raw = text.encode() if isinstance(text, str) else b""
                n = len(padded(raw))
                file = payload_file(padded(raw))
                back = read_payload(file, n)
                rows.append(
                    (
                        None if pd.isna(doc_id) else int(doc_id),
                        len(raw),
                        len(back),
                        hashlib.sha256(back).hexdigest(),
                        zlib.crc32(back[-32:]),
                        len(file),
                        hashlib.sha256(file).hexdigest(),
                        feature(np.frombuffer(back, np.uint8)),
                    )
                )
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, REPORT)
