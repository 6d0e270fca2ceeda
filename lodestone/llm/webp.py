"""Media columns: the lossless WebP bit stream, read and written.

`decode` reads any lossless stream: prefix codes (simple, normal, grouped by a meta image),
back-references, colour cache, and the predictor, cross-colour, subtract-green and palette transforms,
which it inverts in NumPy. `encode` chooses among the transforms by an estimate of the bits they save, and
writes literals, copies of earlier pixels and places in the colour cache under prefix codes made for each
image. Rows are stored one image each; a payload too high for one image is several, end to end.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import lean, slices

#: Fixed values of the format: order of code length codes; plane offsets of the 120 short distance codes.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
SIGNATURE, MAX_SIDE = 0x2F, 16384
#: Fixed values of the format: multiplier of the cache's hash, longest copy, farthest one, and transforms by number.
HASH, LONGEST, FARTHEST = 0x1E35A7BD, 4096, (1 << 20) - 120
TRANSFORMS = ("predict", "cross", "green", "palette")
CACHE_BITS = 10
SHORT = 4096  # pixels


class Bits:
    """The bits of a stream, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 1 + (n + 7) // 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value


@lru_cache(maxsize=16)
def reversed_bits(n: int) -> np.ndarray:
    """Every value of n bits with its bits in opposite order."""
    value = np.arange(1 << n)
    return sum((value >> k & 1) << (n - 1 - k) for k in range(n)) + 0 * value


class Code:
    """Most bits of a code, and by the next bits of the stream the symbol times 16 and the bits it takes. One symbol alone takes no bits."""

    def __init__(self, most: int, entries: np.ndarray):
        self.most, self.entries = most, entries

    @cached_property
    def table(self) -> list[int]:
        return self.entries.tolist()


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Used symbols in order of their codes, the lengths of these, and the longest."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[used].astype(np.int64)
    return used, n, int(n[-1]) if len(n) else 0


def code_of(lengths: np.ndarray) -> Code:
    used, n, most = canonical(lengths)
    if len(used) < 2:
        return Code(0, np.array([16 * int(used[0]) if len(used) else 0]))
    run = 1 << (most - n)
    if run.sum() != 1 << most:
        raise ValueError("code lengths do not make a whole prefix code")
    # in order of their codes, symbols fill the table in runs; the stream has the bits of a code the other way round
    return Code(most, np.repeat(used << 4 | n, run)[reversed_bits(most)])


def _symbol(bits: Bits, code: Code) -> int:
    entry = code.table[bits.peek(code.most)]
    bits.at += entry & 15
    return entry >> 4


#: Codes read lately, by size of the alphabet and their first bits: number of bits, the bits, and the code.
_KNOWN: dict[tuple[int, int], tuple[int, int, Code]] = {}


def _read_code(bits: Bits, size: int) -> Code:
    begin = bits.at
    key = size, bits.peek(64)
    if key in _KNOWN:
        # what is met again stays longest
        n, same, code = _KNOWN[key] = _KNOWN.pop(key)
        if bits.peek(n) == same:
            bits.at += n
            return code
    code = _parse_code(bits, size)
    n, bits.at = bits.at - begin, begin
    if len(_KNOWN) >= 64:
        del _KNOWN[next(iter(_KNOWN))]
    _KNOWN[key] = n, bits.peek(n), code
    bits.at = begin + n
    return code


def _parse_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return code_of(lengths)
    own = np.zeros(19, np.uint8)
    for k in range(4 + bits.read(4)):
        own[CODE_ORDER[k]] = bits.read(3)
    code = code_of(own)
    most, table = code.most, code.table
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last, mask, place, data = 0, 8, (1 << most) - 1, bits.at, bits.data
    while at < size and left:
        left -= 1
        # a length code has 7 bits at most, and what may follow it as many
        value = int.from_bytes(data[place >> 3 : (place >> 3) + 3], "little") >> (place & 7)
        entry = table[value & mask]
        s, n = entry >> 4, entry & 15
        place += n
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
            continue
        extra, first, own_value = ((2, 3, last), (3, 3, 0), (7, 11, 0))[s - 16]
        times = first + (value >> n & ((1 << extra) - 1))
        place += extra
        if at + times > size:
            raise ValueError("code lengths run over the alphabet")
        lengths[at : at + times] = own_value
        at += times
    bits.at = place
    return code_of(lengths)


def _long(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


#: Bytes whose bits are looked at together, so that arrays by bit stay in the processor's cache, and the shifts of a byte.
STRETCH, _SHIFTS = 1 << 11, np.arange(8)


def _cached(values: np.ndarray, slots: np.ndarray, known: np.ndarray, cache: list[int]) -> list[int]:
    """The values, those of places in the cache looked up; the cache takes all."""
    out = []
    append = out.append
    for value, slot, old in zip(values.tolist(), slots.tolist(), known.tolist(), strict=True):
        if old:
            value = cache[slot]
            if not value:  # perhaps of a place that was never filled
                cache[0] = 0
        else:
            cache[slot] = value
        append(value)
    return out


def _read_stretches(bits: Bits, group: list[Code], out: list[int], until: int, width: int, total: int, cache: list[int], shift: int) -> None:
    """Pixels up to `until` under one group of codes, whose symbols take some bits and 57 at most a pixel.

    What a literal or a place in the cache that began at a bit would take is worked out for all bits of a stretch at once;
    they are then walked from each to the next, and their values taken together. Copies are read one by one.
    """
    (green, g_mask), *others = [(c.entries, (1 << c.most) - 1) for c in group[:4]]
    most, data = sum(c.most for c in group[:4]), bits.data
    while (left := until - len(out)) > 0 and bits.at <= 8 * len(data):
        first = bits.at >> 3
        size = min(STRETCH, (left * most >> 3) + 2)
        # the 8 bytes from each byte on, and from each bit on 57 bits of these at least; zeros stand behind the end
        part = data[first : first + size + 8].ljust(size + 8, b"\0")
        view = (np.ndarray((size, 1), "<i8", part, 0, (1, 1)) >> _SHIFTS).reshape(-1)
        entry = green.take(view & g_mask)
        used = entry & 15
        for table, mask in others:
            next_ = view >> used
            next_ &= mask
            next_ = table.take(next_)
            next_ &= 15
            used += next_
        used *= entry < 4096
        if cache:
            used += (entry & 15) * (entry >= 4480)
        steps, at, stop = used.astype(np.uint8).tobytes(), bits.at - 8 * first, len(view)
        while left > 0 and at < stop:
            places: list[int] = []
            append = places.append
            while at < stop and (step := steps[at]):
                append(at)
                at += step
            if len(places) > left:
                at = places[left]
                del places[left:]
            if places:
                own = view[places]
                symbol = green[own & g_mask]
                value, taken = symbol >> 4 << 8, symbol & 15
                for (table, mask), by in zip(others, (16, 0, 24), strict=True):
                    entry = table[(own >> taken) & mask]
                    value |= entry >> 4 << by
                    taken += entry & 15
                if cache:
                    known = symbol >= 4480
                    out += _cached(value, np.where(known, (symbol >> 4) - 280, (HASH * value & 0xFFFFFFFF) >> shift), known, cache)
                else:
                    out += value.tolist()
                left = until - len(out)
            if left > 0 and at < stop:
                prefix = int(green[view[at] & g_mask])
                bits.at = 8 * first + at + (prefix & 15)
                new = _copied(bits, (prefix >> 4) - 256, group[4], out, width, total)
                out += new
                for v in new if cache else ():
                    cache[(HASH * v & 0xFFFFFFFF) >> shift] = v
                at, left = bits.at - 8 * first, until - len(out)
        bits.at = 8 * first + at


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB values of one entropy-coded image, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache of more than 11 bits")
    meta, meta_bits, meta_width, groups = [0], 14, 1, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta_width = -(-width >> meta_bits)
        meta = ((_pixels(bits, meta_width, -(-height >> meta_bits), False) >> 8) & 0xFFFF).tolist()
        groups = max(meta) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    total, out = width * height, []
    cache, shift = [0] * (1 << cache_bits) if cache_bits else [], 32 - cache_bits
    while (at := len(out)) < total:
        # pixels up to the next change of the group of codes
        row = at // width
        until = total if groups == 1 else min(total, row * width + min(width, ((at - row * width >> meta_bits) + 1) << meta_bits))
        group = codes[meta[(row >> meta_bits) * meta_width + (at - row * width >> meta_bits)]] if groups > 1 else codes[0]
        most = sum(c.most for c in group[:4])
        # a stretch is worth its arrays; no step of it may be of no bits
        if until - at >= 16 and most <= 57 and (group[0].most or most and not cache):
            _read_stretches(bits, group, out, until, width, total, cache, shift)
        else:
            _read_singly(bits, group, out, until, width, total, cache, shift)
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def _read_singly(bits: Bits, group: list[Code], out: list[int], until: int, width: int, total: int, cache: list[int], shift: int) -> None:
    """Pixels up to `until` under one group of codes, symbol by symbol."""
    while len(out) < until and bits.at <= 8 * len(bits.data):
        green = _symbol(bits, group[0])
        if green < 256:
            red, blue, alpha = (_symbol(bits, c) for c in group[1:4])
            new = [alpha << 24 | red << 16 | green << 8 | blue]
        elif green < 280:
            new = _copied(bits, green - 256, group[4], out, width, total)
        else:
            new = [cache[green - 280]]
        out += new
        for value in new if cache else ():
            cache[(HASH * value & 0xFFFFFFFF) >> shift] = value


def _copied(bits: Bits, prefix: int, distances: Code, out: list[int], width: int, total: int) -> list[int]:
    length, far = _long(bits, prefix), _long(bits, _symbol(bits, distances))
    if far > 120:
        back = far - 120
    else:
        x, y = NEAR[far - 1]
        back = max(1, x + y * width)
    at = len(out)
    if back > at or at + length > total:
        raise ValueError("back-reference outside the image")
    new = out[at - back : at - back + length]
    while len(new) < length:
        new += new[: length - len(new)]
    return new


def _channels(argb: np.ndarray) -> np.ndarray:
    return argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4).astype(np.int32)  # blue, green, red, alpha


def _argb(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((channels & 255).astype(np.uint8)).view("<u4")[..., 0]


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, left, top, top_right, top_left):
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return top_right
        case 4:
            return top_left
        case 5:
            return _half(_half(left, top_right), top)
        case 6:
            return _half(left, top_left)
        case 7:
            return _half(left, top)
        case 8:
            return _half(top_left, top)
        case 9:
            return _half(top, top_right)
        case 10:
            return _half(_half(left, top_left), _half(top, top_right))
        case 11:
            return np.where((np.abs(top - top_left).sum(-1) < np.abs(left - top_left).sum(-1))[..., None], left, top)
        case 12:
            return np.clip(left + top - top_left, 0, 255)
        case 13:
            mean = _half(left, top)
            # halves are rounded towards zero
            return np.clip(mean + np.trunc((mean - top_left) / 2).astype(np.int32), 0, 255)
    return np.array([0, 0, 0, 255], np.int32)


def _undo_predictor(rest: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width = rest.shape
    out = _channels(rest)
    out[0, 0] = (out[0, 0] + _predict(0, None, None, None, None)) & 255
    out[0] = np.cumsum(out[0], 0) & 255
    for y in range(1, height):
        own = ((modes[y >> block] >> 8) & 15)[np.arange(width) >> block]
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        above = np.concatenate([out[y - 1], out[y, :1]])
        if (own[1:] == own[-1]).all() and own[-1] in (0, 2, 3, 4, 8, 9) and width > 1:
            top_right = above[2:].copy()
            out[y, 1:] = (out[y, 1:] + _predict(int(own[-1]), None, above[1:-1], top_right, above[:-2])) & 255
        elif (own[1:] == 1).all():
            out[y] = np.cumsum(out[y], 0) & 255
        else:
            for x in range(1, width):
                out[y, x] = (out[y, x] + _predict(int(own[x]), out[y, x - 1], above[x], above[x + 1], above[x - 1])) & 255
    return _argb(out)


def _undo_cross(argb: np.ndarray, elements: np.ndarray, block: int) -> np.ndarray:
    height, width = argb.shape
    signed = lambda v: v.astype(np.uint8).astype(np.int8).astype(np.int32)
    e = _channels(elements)[np.arange(height)[:, None] >> block, np.arange(width) >> block]
    out = _channels(argb)
    green = signed(out[..., 1])
    out[..., 2] = (out[..., 2] + ((signed(e[..., 0]) * green) >> 5)) & 255
    out[..., 0] += (signed(e[..., 1]) * green) >> 5
    out[..., 0] += (signed(e[..., 2]) * signed(out[..., 2])) >> 5
    return _argb(out)


def _undo_palette(argb: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    """Indices stand in green; up to 16 colours several to a pixel. An index behind the palette is transparent black."""
    pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    x, each = np.arange(width), 8 >> pack
    index = (argb[:, x >> pack] >> 8 & 255) >> ((x & ((1 << pack) - 1)) * each).astype(np.uint32) & ((1 << each) - 1)
    return np.concatenate([colours, np.zeros(256, np.uint32)])[index]


def _undo_green(argb: np.ndarray) -> np.ndarray:
    out = _channels(argb)
    out[..., 0] += out[..., 1]
    out[..., 2] += out[..., 1]
    return _argb(out)


def decode_stream(data: bytes) -> np.ndarray:
    """(height, width) ARGB values of a lossless bit stream."""
    bits = Bits(data)
    if bits.read(8) != SIGNATURE:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, stored, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform stands twice")
        seen.add(kind)
        if kind in (0, 1):
            block = bits.read(3) + 2
            size = (-(-height >> block), -(-stored >> block))
            image = _pixels(bits, size[1], size[0], False).reshape(size)
            step = _undo_predictor if kind == 0 else _undo_cross
            undo.append(lambda v, step=step, image=image, block=block: step(v, image, block))
        elif kind == 2:
            undo.append(_undo_green)
        else:
            n = bits.read(8) + 1
            deltas = _channels(_pixels(bits, n, 1, False))
            colours = _argb(np.cumsum(deltas, 0))
            undo.append(lambda v, colours=colours, w=stored: _undo_palette(v, colours, w))
            stored = -(-stored >> (3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0))
    argb = _pixels(bits, stored, height, True).reshape(height, stored)
    if bits.at > 8 * len(data):
        raise ValueError("the stream ends early")
    for step in reversed(undo):
        argb = step(argb)
    return argb


def decode(media: bytes) -> list[np.ndarray]:
    """ARGB arrays of all images that stand end to end in `media`."""
    images, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("no lossless WebP image")
        size, chunk = struct.unpack_from("<I", media, at + 4)[0], struct.unpack_from("<I", media, at + 16)[0]
        images.append(decode_stream(media[at + 20 : at + 20 + chunk]))
        at += 8 + size
    return images


class Writer:
    """Fields of bits, lowest first: one by one, or arrays of them."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.values: list[int] = []
        self.done: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, bits: int, value: int) -> None:
        self.sizes.append(bits)
        self.values.append(value)

    def put_all(self, bits: np.ndarray, values: np.ndarray) -> None:
        self.done += [(np.array(self.sizes, np.int64), np.array(self.values, np.uint64)), (bits, values.astype(np.uint64))]
        self.sizes, self.values = [], []

    def bytes(self) -> bytes:
        self.put_all(np.zeros(0, np.int64), np.zeros(0, np.uint64))
        bits, values = (np.concatenate(c) for c in zip(*self.done, strict=True))
        bits, values = bits[bits > 0], values[bits > 0]
        ends = np.cumsum(bits)
        start = ends - bits
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out = np.zeros(int(ends[-1] >> 6) + 2, "<u8")
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.where(shift > 0, values >> (np.uint64(64) - np.maximum(shift, 1)), 0)
        out[word[first] + 1] |= np.bitwise_or.reduceat(over, first)
        return out.tobytes()[: int(ends[-1] + 7) // 8]


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code of `most` bits at most; one symbol alone has length 1."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    least = 1
    while True:
        # leaves and joined nodes both come in order of weight, so the two lightest are at the heads
        weight = np.maximum(counts[used], least).tolist()
        n = len(weight)
        parent, leaf, node = [0] * (2 * n - 1), 0, n
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (node >= new or weight[leaf] <= weight[node]):
                    own, leaf = leaf, leaf + 1
                else:
                    own, node = node, node + 1
                parent[own] = new
                total += weight[own]
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            lengths[used] = depth[:n]
            return lengths
        least = max(2 * least, int(counts[used[0]]) + 1)


def codes_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By symbol: the code as it stands in the stream, and its bits; one symbol alone takes none."""
    value, taken = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used, n, most = canonical(lengths)
    if len(used) > 1:
        run = 1 << (most - n)
        value[used], taken[used] = reversed_bits(most)[np.cumsum(run) - run], n
    return value, taken


def _put_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist() or [0]
    if len(used) <= 2 and used[-1] < 256:
        w.put(1, 1)
        w.put(1, len(used) - 1)
        w.put(1, int(used[0] > 1))
        w.put(8 if used[0] > 1 else 1, used[0])
        for s in used[1:]:
            w.put(8, s)
        return
    symbols: list[int] = []  # and with each its extra bits and their value
    extras: list[tuple[int, int]] = []
    change = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
    value = lengths[change[:-1]].tolist()
    last = 8
    for n, a, b in zip(value, change, change[1:], strict=False):
        times = b - a
        if n and n != last:
            symbols.append(n)
            extras.append((0, 0))
            times -= 1
            last = n
        while times >= 3:
            symbol, extra, first, most = (16, 2, 3, 6) if n else (18, 7, 11, 138) if times > 10 else (17, 3, 3, 10)
            now = min(times, most)
            symbols.append(symbol)
            extras.append((extra, now - first))
            times -= now
        symbols += [n] * times
        extras += [(0, 0)] * times
    own = code_lengths(np.bincount(symbols, minlength=19), 7)
    listed = [int(own[s]) for s in CODE_ORDER]
    many = max(4, max(k + 1 for k, n in enumerate(listed) if n))
    w.sizes += [1, 4, *[3] * many, 1]
    w.values += [0, many - 4, *listed[:many], 0]
    code, taken = (v.tolist() for v in codes_of(own))
    w.sizes += [taken[s] + e[0] for s, e in zip(symbols, extras, strict=True)]
    w.values += [code[s] | e[1] << taken[s] for s, e in zip(symbols, extras, strict=True)]


def _prefixed(n: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their value of a length or distance."""
    if n <= 4:
        return n - 1, 0, 0
    high = (n - 1).bit_length() - 1
    extra = high - 1
    return 2 * high + (n - 1 >> extra & 1), extra, n - 1 & (1 << extra) - 1


@lru_cache(maxsize=64)
def _near(width: int) -> dict[int, int]:
    found: dict[int, int] = {}
    for k, (x, y) in enumerate(NEAR):
        found.setdefault(max(1, x + y * width), k + 1)
    return found


def copies_in(v: np.ndarray) -> list[tuple[int, int, int]]:
    """Place, length and distance of runs of pixels that stood before, taken greedily, each from the last place where its first two stood."""
    if len(v) < 4:
        return []
    pair = v[:-1].astype(np.uint64) << np.uint64(32) | v[1:]
    order = np.argsort(pair, kind="stable")
    same = pair[order][1:] == pair[order][:-1]
    here, there = order[1:][same], order[:-1][same]
    # a copy has three pixels at least
    third = v[np.minimum(here + 2, len(v) - 1)] == v[there + 2]
    third &= here + 2 < len(v)
    here, there = here[third], there[third]
    by = np.argsort(here)
    out, done = [], 0
    for i, j in zip(here[by].tolist(), there[by].tolist(), strict=True):
        if i < done:
            continue
        length = 0
        for most in (16, LONGEST):
            differ = np.flatnonzero(v[i : i + most] != v[j : j + most][: len(v) - i])
            length = int(differ[0]) if len(differ) else min(most, len(v) - i)
            if length < most:
                break
        if length >= 3 and i - j <= FARTHEST:
            out.append((i, length, i - j))
            done = i + length
    return out


#: Weights of bytes in texts, by which the preset code is made; all others weigh 1.
WEIGHTS = {" ": 600, "ehnt": 350, "aoirs": 250, "dlu": 120, "bcfgmpvwy": 40, ".,\n": 40, "jkqxz": 10, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": 10}
SIZES = (280, 256, 256, 256, 40)
STARTS = np.cumsum((0, *SIZES[:-1]))


class Codes(NamedTuple):
    """Code lengths, codes and their bits for green (with lengths of copies and the cache), red, blue, alpha and distances."""

    lengths: list[np.ndarray]
    codes: list[np.ndarray]
    taken: list[np.ndarray]


def codes_for(counts: list[np.ndarray]) -> Codes:
    lengths = [code_lengths(c, 12 if len(c) > 256 else 10) for c in counts]
    coded = [codes_of(n) for n in lengths]
    return Codes(lengths, [c for c, _ in coded], [n for _, n in coded])


@lru_cache(maxsize=1)
def preset() -> tuple[Codes, np.ndarray, np.ndarray, np.ndarray]:
    """Codes for short texts, to which codes of their own would add more than they save, the bits that describe them, and all their lengths."""
    weights = np.ones(256, np.int64)
    weights[0xA0:0xC0], weights[0xC3], weights[255] = 10, 40, 40
    for letters, weight in WEIGHTS.items():
        weights[list(letters.encode())] = weight
    codes = codes_for([np.concatenate([weights, np.full(24, 40)]), weights, weights, weights, np.full(40, 1)])
    w = Writer()
    for n in codes.lengths:
        _put_code(w, n)
    return codes, np.array(w.sizes, np.int64), np.array(w.values, np.uint64), np.concatenate(codes.lengths).astype(np.int64)


def _entropy(counts: np.ndarray) -> float:
    some = counts[counts > 0]
    return float(some.sum() * np.log2(some.sum()) - (some * np.log2(some)).sum()) if len(some) else 0.0


def _put_image(w: Writer, v: np.ndarray, width: int, main: bool) -> None:
    """Pixels as literals, copies and places in the colour cache, under one group of codes: the preset one, or their own."""
    copies = copies_in(v)
    own = np.ones(len(v), bool)
    for at, length, _ in copies:
        own[at + 1 : at + length] = False
    begins = np.flatnonzero(own)
    where = np.searchsorted(begins, np.array([c[0] for c in copies], np.int64))
    near = _near(width)
    runs = [(_prefixed(length), _prefixed(near.get(far, far + 120))) for _, length, far in copies]
    value = v[begins].astype(np.int64)
    plain = np.ones(len(begins), bool)
    plain[where] = False
    green = value >> 8 & 255
    green[where] = [256 + length[0] for length, _ in runs]
    rest = [value >> shift & 255 for shift in (16, 0, 24)]
    channels = [green, *[c[plain] for c in rest], np.array([far[0] for _, far in runs], np.int64)]
    codes, sizes, values, preset_lengths = preset()
    counts = np.bincount(np.concatenate([c + start for c, start in zip(channels, STARTS.tolist(), strict=True)]), minlength=sum(SIZES))
    totals = np.add.reduceat(counts, STARTS)
    own_bits = _weighed(totals).sum() - _weighed(counts).sum() + 6 * np.count_nonzero(counts) + 400
    bits = int(preset_lengths @ counts) + int(sizes.sum())
    # codes of their own take most of the time of a short image, so they must save a third
    if len(begins) <= SHORT and bits < 30 * len(v) and bits <= 1.5 * own_bits:
        w.put(1, 0)
        if main:
            w.put(1, 0)
        w.put_all(sizes, values)
    else:
        slot = (v.astype(np.uint64) * np.uint64(HASH) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)
        order = np.argsort(slot, kind="stable")
        hit = np.zeros(len(v), bool)
        hit[order[1:]] = (slot[order][1:] == slot[order][:-1]) & (v[order][1:] == v[order][:-1])
        hit = hit[begins] & plain
        cache_bits = CACHE_BITS if np.count_nonzero(hit) >= 24 else 0
        counts = np.split(counts, STARTS[1:])
        if cache_bits:
            green = np.where(hit, 280 + slot[begins].astype(np.int64), green)
            plain &= ~hit
            counts = [np.bincount(green, minlength=280 + (1 << cache_bits)), *[np.bincount(c[plain], minlength=256) for c in rest], counts[4]]
        codes = codes_for(counts)
        w.put(1, int(cache_bits > 0))
        if cache_bits:
            w.put(4, cache_bits)
        if main:
            w.put(1, 0)
        for n in codes.lengths:
            _put_code(w, n)
    bits, values = codes.taken[0][green], codes.codes[0][green]
    for c, code, taken in zip(rest, codes.codes[1:4], codes.taken[1:4], strict=True):
        values |= np.where(plain, code[c] << bits, 0)
        bits += np.where(plain, taken[c], 0)
    code, taken = codes.codes[4], codes.taken[4]
    for k, (length, far) in zip(where.tolist(), runs, strict=True):
        for n, more in ((length[1], length[2]), (int(taken[far[0]]), int(code[far[0]])), (far[1], far[2])):
            values[k] |= more << int(bits[k])
            bits[k] += n
    w.put_all(bits, values)


_WEIGHED = np.arange(1 << 12) * np.log2(np.maximum(np.arange(1 << 12), 1))


def _weighed(counts: np.ndarray) -> np.ndarray:
    """Counts times their logarithms, mostly looked up."""
    return _WEIGHED[counts] if counts.max() < len(_WEIGHED) else counts * np.log2(np.maximum(counts, 1))


def _bits_of(*images: np.ndarray) -> list[float]:
    """Bits of the four channels (bytes) of each image under codes of their own."""
    many = len(images)
    cells = np.stack(images).reshape(many, -1, 4) + np.arange(0, 1024 * many, 256).reshape(many, 1, 4)
    counts = np.bincount(cells.reshape(-1), minlength=1024 * many).reshape(many, 1024)
    pixels = cells.shape[1]
    return (4 * pixels * np.log2(pixels) - _weighed(counts).sum(1)).tolist()


def _raw(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb).view(np.uint8).reshape(*argb.shape, 4)


def take_green(argb: np.ndarray) -> np.ndarray:
    out = _channels(argb)
    out[..., 0] -= out[..., 1]
    out[..., 2] -= out[..., 1]
    return _argb(out)


def take_prediction(argb: np.ndarray, mode: int) -> np.ndarray:
    """What is left of each pixel when one mode predicts it from its neighbours."""
    v = _channels(argb)
    out = v.copy()
    out[0, 0] -= _predict(0, None, None, None, None)
    out[0, 1:] -= v[0, :-1]
    out[1:, 0] -= v[:-1, 0]
    if len(v) > 1 and v.shape[1] > 1:
        above = np.concatenate([v[:-1], v[1:, :1]], 1)
        out[1:, 1:] -= _predict(mode, v[1:, :-1], above[:, 1:-1], above[:, 2:], above[:, :-2])
    return _argb(out)


def take_cross(argb: np.ndarray, elements: tuple[int, int, int]) -> np.ndarray:
    """Without the parts of red and blue that green, and of blue that red, foretell; multipliers in 32nds: green to red, green to blue, red to blue."""
    out = _channels(argb)
    green, red = (out[..., k].astype(np.int8).astype(np.int32) for k in (1, 2))
    out[..., 2] -= elements[0] * green >> 5
    out[..., 0] -= (elements[1] * green >> 5) + (elements[2] * red >> 5)
    return _argb(out)


def cross_elements(argb: np.ndarray) -> tuple[int, int, int]:
    """Slopes of red on green, of blue on green beyond red's part, and of blue on red, in 32nds."""
    blue_green_red = np.ascontiguousarray(argb).view(np.int8).reshape(-1, 4)[:, :3].astype(np.float32)
    blue_green_red -= blue_green_red.mean(0)
    c = blue_green_red.T @ blue_green_red
    rounded = lambda v: max(-128, min(127, round(32 * float(v))))
    red_to_blue = rounded(c[0, 2] / max(c[2, 2], 1e-9))
    return rounded(c[1, 2] / max(c[1, 1], 1e-9)), rounded((c[0, 1] - red_to_blue / 32 * c[1, 2]) / max(c[1, 1], 1e-9)), red_to_blue


def plan(argb: np.ndarray) -> list[tuple]:
    """The transforms that save most by an estimate of the bits: a palette, or any of subtract-green, one predictor and cross-colour."""
    raw = _raw(argb)
    # cheap looks at the differences to green, to the left and to the row above say which transforms are worth a try
    green, left, above = raw.copy(), raw.copy(), raw.copy()
    green[..., 0] -= raw[..., 1]
    green[..., 2] -= raw[..., 1]
    left[:, 1:] -= raw[:, :-1]
    above[1:] -= raw[:-1]
    best, by_green, by_left, by_above = _bits_of(raw, green, left, above)
    steps: list[tuple] = []
    colours, by_palette = np.unique(argb.reshape(-1)[:512]), best
    if len(colours) <= 256 and argb.size > 512:
        colours = np.unique(argb)
    if len(colours) <= 256:
        by_palette = _entropy(np.bincount(np.searchsorted(colours, argb.reshape(-1)))) + 24 * len(colours) + 300

    def take(options: list[tuple[tuple, np.ndarray]]) -> None:
        nonlocal argb, best
        bits = _bits_of(*[_raw(image) for _, image in options])
        k = int(np.argmin(bits))
        if bits[k] + 100 < best:
            argb, best = options[k][1], bits[k]
            steps.append(options[k][0])

    if by_green < best:
        take([(("green",), take_green(argb))])
    if min(by_left, by_above) < 0.9 * best:
        take([(("predict", m), take_prediction(argb, m)) for m in range(1, 14)])
    elements = cross_elements(argb)
    if max(map(abs, elements)) > 8:
        take([(("cross", elements), take_cross(argb, elements))])
    return [("palette", colours)] if by_palette < best else steps


def encode(argb: np.ndarray, steps: list[tuple] | None = None) -> bytes:
    """A file of (height, width) ARGB values, by the transforms of `plan` or those given."""
    height, width = argb.shape
    steps = plan(argb) if steps is None else steps
    w = Writer()
    for bits, value in ((8, SIGNATURE), (14, width - 1), (14, height - 1), (1, 1), (3, 0)):
        w.put(bits, value)
    for step in steps:
        w.put(1, 1)
        w.put(2, TRANSFORMS.index(step[0]))
        blocks = -(-height >> 9), -(-argb.shape[1] >> 9)
        if step[0] == "green":
            argb = take_green(argb)
        elif step[0] == "palette":
            colours = step[1]
            w.put(8, len(colours) - 1)
            deltas = _channels(colours)
            deltas[1:] = deltas[1:] - deltas[:-1]
            _put_image(w, _argb(deltas), len(colours), False)
            argb = pack_palette(np.searchsorted(colours, argb), len(colours))
        else:
            w.put(3, 9 - 2)  # blocks of 512 pixels, all alike
            if step[0] == "predict":
                element, argb = step[1] << 8, take_prediction(argb, step[1])
            else:
                to_red, to_blue, red_to_blue = (e & 255 for e in step[1])
                element, argb = red_to_blue << 16 | to_blue << 8 | to_red, take_cross(argb, step[1])
            _put_image(w, np.full(blocks[0] * blocks[1], element, np.uint32), blocks[1], False)
    w.put(1, 0)
    _put_image(w, argb.reshape(-1), argb.shape[1], True)
    stream = w.bytes()
    padded = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + padded


def pack_palette(index: np.ndarray, colours: int) -> np.ndarray:
    """Indices as green values; up to 16 colours several to a pixel."""
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    height, width = index.shape
    wide = np.zeros((height, -(-width >> pack) << pack), np.uint32)
    wide[:, :width] = index
    parts = wide.reshape(height, -1, 1 << pack) << (np.arange(1 << pack, dtype=np.uint32) * np.uint32(8 >> pack))
    return np.uint32(0xFF000000) | np.bitwise_or.reduce(parts, 2) << np.uint32(8)


def pixels_of(samples: np.ndarray, width: int) -> np.ndarray:
    """(height, width) ARGB values from 8-bit samples, four to a pixel: green, red, blue, alpha."""
    return np.ascontiguousarray(samples.reshape(-1, 4)[:, [2, 0, 1, 3]]).view("<u4").reshape(-1, width)


def samples_of(argb: np.ndarray) -> np.ndarray:
    """Samples in the order in which `pixels_of` takes them."""
    return np.ascontiguousarray(argb).view(np.uint8).reshape(-1, 4)[:, [1, 2, 0, 3]].reshape(-1)


UNIT, ROW = 576, 144


def store(payload: np.ndarray) -> bytes:
    """Payload bytes, a multiple of UNIT, as images of ROW pixels a row."""
    most = UNIT * MAX_SIDE
    return b"".join(encode(pixels_of(payload[i : i + most], ROW)) for i in range(0, len(payload), most))


def feature_of(samples: np.ndarray, images: int) -> str:
    """Sides, sums of the four channels, sum of squares and how many differ from the sample before."""
    wide = samples.reshape(-1, 4).sum(0, dtype=np.int64)
    squares = int(np.bincount(samples, minlength=256) @ np.arange(256, dtype=np.int64) ** 2)
    return f"{ROW}x{len(samples) // UNIT}/{images};" + ",".join(map(str, wide.tolist())) + f";{squares};{np.count_nonzero(samples[1:] != samples[:-1])}"


OUT = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def media_report(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """doc_id and the columns of OUT for every document, and the stored `media` if wanted.

    Null and empty texts are one unit of bytes 255. Everything after media_bytes is computed on bytes that
    were read back from the stored form. Rows that repeat have equal values.
    """
    names = [*OUT, *(["media"] if with_media else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            out: dict[str, list] = {c: [] for c in names}
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                payload = np.full(max(1, -(-(b - a) // UNIT)) * UNIT, 255, np.uint8)
                payload[: b - a] = data[a:b]
                media = store(payload)
                images = decode(media)
                back = np.concatenate([samples_of(i) for i in images]) if len(images) > 1 else samples_of(images[0])
                raw = back.tobytes()
                values = (b - a, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(back, len(images)), media)
                for c, v in zip(names, values, strict=False):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(v, OUT.get(c, pa.binary())) for c, v in out.items()]], ["doc_id", *names])

    schema = docs.select("doc_id").schema
    for c in names:
        schema = schema.add(c, "binary" if c == "media" else "string" if OUT[c] == pa.string() else "long")
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)
