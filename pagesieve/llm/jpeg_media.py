"""Media columns: baseline JPEG, its dimensions and the hashes of its luminance thumbnail.

The reader parses the markers of baseline files, Huffman-decodes the scan and keeps the DC coefficients of the
first component, whose image is the thumbnail at an eighth of the size. Restart intervals are independent, so the
intervals of many files are decoded side by side as numpy arrays, a symbol of each at a time.

The writer stores bytes as the DC coefficients of constant 8 x 8 blocks, WIDTH blocks a row and a restart
interval for each row, so that every block's samples equal its byte and the thumbnail of the file is the
stored bytes. What does not fit the height limit goes on in further images, one after another.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

UNIT = 192
WIDTH = 192
MOST_ROWS = 8191
#: Code lengths of the DC size categories 0 to 8, for differences between bytes of prose.
DC_LENGTHS = {4: 2, 3: 3, 6: 3, 7: 3, 2: 4, 5: 4, 0: 5, 1: 5, 8: 6}
GROUP_BYTES = 2 << 20


def canonical_codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length) of a table as DHT describes it."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _dht(kind: int, lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(v == n for v in lengths.values()) for n in range(1, 17)]
    return bytes([kind, *counts, *symbols]), canonical_codes(counts, symbols)


_DC_TABLE, _DC_CODES = _dht(0x00, DC_LENGTHS)
_AC_TABLE, _AC_CODES = _dht(0x10, {0x00: 1})


@lru_cache(1)
def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for every difference from -255 to 255: DC code, its extra bits, end of block."""
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    end, end_size = _AC_CODES[0]
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = _DC_CODES[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255] = ((code << size | extra) << end_size) | end
        sizes[d + 255] = length + size + end_size
    return bits, sizes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _image(samples: np.ndarray) -> bytes:
    """One file for rows of WIDTH bytes."""
    rows = len(samples)
    bits, sizes = _block_codes()
    delta = np.diff(samples.astype(np.int64), axis=1, prepend=128) + 255
    value, size = bits[delta], sizes[delta]
    ends = np.cumsum(size, axis=1)
    lengths = -(-ends[:, -1] // 8)
    first = np.cumsum(lengths) - lengths
    at = (first[:, None] * 8 + ends - size).ravel()
    word = value.ravel() << (24 - size.ravel() - (at & 7))
    data = np.zeros(int(lengths.sum()) + 2, np.int64)
    byte = at >> 3
    for i in range(3):
        np.add.at(data, byte + i, (word >> (16 - 8 * i)) & 255)
    data = data[:-2]
    data[first + lengths - 1] |= (1 << (lengths * 8 - ends[:, -1])) - 1
    full = data == 255
    row = np.repeat(np.arange(rows), lengths)
    place = np.arange(len(data)) + (np.cumsum(full) - full) + 2 * row
    out = np.zeros(len(data) + int(full.sum()) + 2 * (rows - 1), np.uint8)
    out[place] = data
    marks = place[first[1:]] - 2
    out[marks], out[marks + 1] = 0xFF, 0xD0 + np.arange(rows - 1) % 8
    head = b"\xff\xd8" + _segment(0xDB, bytes([0, 8]) + b"\x01" * 63) + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + bytes([1, 0x11, 0]))
    head += _segment(0xC4, _DC_TABLE + _AC_TABLE) + _segment(0xDD, struct.pack(">H", WIDTH)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return head + out.tobytes() + b"\xff\xd9"


def stored(payload: bytes) -> bytes:
    """The payload, a positive multiple of UNIT bytes, as one or more baseline files."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(_image(samples[i : i + MOST_ROWS]) for i in range(0, len(samples), MOST_ROWS))


@dataclass
class Frame:
    """Headers and scan of one baseline image."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # of DC
    tables: dict[int, tuple[list[int], list[int]]] = field(default_factory=dict)
    interval: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # place in parts, DC and AC table
    data: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint8))

    def layout(self) -> list[tuple[int, int, int]]:
        """For each block of an MCU: component, DC table, AC table."""
        if len(self.scan) == 1:
            return self.scan
        return [s for s in self.scan for _ in range(self.parts[s[0]][1] * self.parts[s[0]][2])]

    def units(self) -> tuple[int, int]:
        """MCUs across and down."""
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.scan) == 1:
            _, own_h, own_v, _ = self.parts[self.scan[0][0]]
            return -(-(-(-self.width * own_h // h)) // 8), -(-(-(-self.height * own_v // v)) // 8)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(media: bytes) -> Iterator[Frame]:
    """The images of a file or of several that follow one another. ValueError if one isn't baseline JPEG."""
    at = 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        frame = Frame()
        while True:
            if at + 2 > len(media) or media[at] != 0xFF:
                raise ValueError("no marker")
            marker = media[at + 1]
            at += 2
            if marker == 0xFF:
                at -= 1
                continue
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", media, at)[0]
            body = media[at + 2 : at + size]
            at += size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    frame.quantisers[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                    body = body[65 + 64 * bool(wide) :]
            elif marker == 0xC4:
                while body:
                    counts = list(body[1:17])
                    frame.tables[body[0]] = (counts, list(body[17 : 17 + sum(counts)]))
                    body = body[17 + sum(counts) :]
            elif marker == 0xC0:
                bits, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise ValueError("not 8 bits a sample")
                frame.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xDD:
                frame.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                ids = [p[0] for p in frame.parts]
                scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, 16 | body[2 + 2 * i] & 15) for i in range(body[0])]
                rest = np.frombuffer(media, np.uint8, offset=at)
                marks = np.flatnonzero(rest[:-1] == 0xFF)
                after = rest[marks + 1]
                stop = marks[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
                length = int(stop[0]) if len(stop) else len(rest)
                if not frame.scan or scan[0][0] == 0:  # the scan with the luminance
                    frame.scan, frame.data = scan, rest[:length]
                at += length
        yield frame


def _lookup(table: tuple[list[int], list[int]]) -> np.ndarray:
    """length << 8 | symbol for every 16 bits; 0 for codes that the table lacks."""
    out = np.zeros(1 << 16, np.uint32)
    for symbol, (code, length) in canonical_codes(*table).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


def _intervals(data: np.ndarray) -> list[np.ndarray]:
    """The scan's restart intervals, without stuffing."""
    full = np.flatnonzero(data[:-1] == 0xFF)
    follow = data[full + 1]
    marks = full[(follow >= 0xD0) & (follow <= 0xD7)]
    keep = np.ones(len(data), bool)
    keep[full[follow == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    return np.split(data[keep], marks - (np.cumsum(~keep) - ~keep)[marks])


def thumbnails(frames: list[Frame]) -> list[np.ndarray]:
    """DC-only luminance of each image, a value for each block of the first component; 0 to 255."""
    kinds: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        layout = tuple(f.layout())
        used = sorted({t for _, d, a in layout for t in (d, a)})
        kinds.setdefault((layout, *(repr(f.tables[t]) for t in used)), []).append(i)
    out: list[np.ndarray] = [np.empty(0)] * len(frames)
    for (layout, *_), own in kinds.items():
        for i, dc in zip(own, _decode([frames[i] for i in own], list(layout)), strict=True):
            out[i] = _arranged(frames[i], dc)
    return out


def _decode(frames: list[Frame], layout: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """DC coefficients of each image's scan, as (MCUs, blocks of an MCU)."""
    parts, blocks, owner = [], [], []
    for i, f in enumerate(frames):
        across, down = f.units()
        left, step = across * down, f.interval or across * down
        for x in _intervals(f.data)[: -(-left // step)]:
            parts.append(x)
            blocks.append(min(left, step) * len(layout))
            owner.append(i)
            left -= step
    tables = sorted({t for _, d, a in layout for t in (d, a)})
    lookup = np.stack([_lookup(frames[0].tables[t]) for t in tables])
    dc_table, ac_table = (np.array([tables.index(b[j]) for b in layout]) for j in (1, 2))
    part_of = np.array([b[0] for b in layout])
    lengths = np.array([len(x) + 8 for x in parts])
    flat = np.full(int(lengths.sum()) + 8, 255, np.uint8)
    begin = np.cumsum(lengths) - lengths
    for b, x in zip(begin, parts, strict=True):
        flat[b : b + len(x)] = x
    wide = flat.astype(np.uint64)
    window = (wide[:-4] << np.uint64(32)) | (wide[1:-3] << np.uint64(24)) | (wide[2:-2] << np.uint64(16)) | (wide[3:-1] << np.uint64(8)) | wide[4:]
    last = (begin + lengths - 5) * 8
    total = np.array(blocks)
    places = np.cumsum(total) - total
    result = np.zeros(int(total.sum()), np.int64)
    alive = np.arange(len(parts))
    at, block, coefficient = begin * 8, np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    before = np.zeros((len(parts), int(part_of.max()) + 1), np.int64)

    def peek(p: np.ndarray) -> np.ndarray:
        """33 bits from each place on."""
        return (window[p >> 3] << (p & 7).astype(np.uint64) & np.uint64((1 << 40) - 1)) >> np.uint64(7)

    if len(layout) == 1 and len(parts):
        done, at, values = _flat_blocks(wide, at, last, lookup[dc_table[0]], lookup[ac_table[0]], int(total.min()))
        block += done
        result[places[:, None] + np.arange(done)] = values.T
        before[:, part_of[0]] = values[-1] if done else 0
        alive = alive[block < total]
    while len(alive):
        p, b = at[alive], block[alive] % len(layout)
        if (p > last[alive]).any():
            raise ValueError("the scan ends early")
        start = coefficient[alive] == 0
        bits = peek(p)
        entry = lookup[np.where(start, dc_table[b], ac_table[b]), (bits >> np.uint64(17)).astype(np.int64)].astype(np.int64)
        if not entry.all():
            raise ValueError("a code that the table lacks")
        symbol, length = entry & 255, entry >> 8
        size = np.where(start, symbol, symbol & 15)
        extra = (bits >> (33 - length - size).astype(np.uint64)).astype(np.int64) & ((1 << size) - 1)
        p = p + length + size
        s = alive[start]
        if len(s):
            value, n = extra[start], size[start]
            value = np.where(value < (1 << n >> 1), value - (1 << n) + 1, value)
            before[s, part_of[b[start]]] += value
            result[places[s] + block[s]] = before[s, part_of[b[start]]]
        k = np.where(start, 1, np.where(symbol == 0, 64, coefficient[alive] + (symbol >> 4) + 1))
        # an end of block that follows at once, as in flat blocks
        entry = lookup[ac_table[b], (peek(np.minimum(p, last[alive])) >> np.uint64(17)).astype(np.int64)].astype(np.int64)
        ends = (k < 64) & (entry & 255 == 0) & (entry > 0)
        p, k = p + np.where(ends, entry >> 8, 0), np.where(ends, 64, k)
        done = k >= 64
        at[alive], coefficient[alive] = p, np.where(done, 0, k)
        block[alive] += done
        if done.any():
            alive = alive[block[alive] < total[alive]]
    cut = np.split(result, places[1:]) if len(places) else []
    joined: list[list[np.ndarray]] = [[] for _ in frames]
    for i, x in zip(owner, cut, strict=True):
        joined[i].append(x)
    return [np.concatenate(x).reshape(-1, len(layout)) for x in joined]


def _flat_blocks(wide: np.ndarray, at: np.ndarray, last: np.ndarray, dc: np.ndarray, ac: np.ndarray, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Blocks of one component that all intervals hold without AC coefficients: their number, the places reached and
    the DC coefficients, a row for each block. It stops at the first block that has more than an end of block."""
    window = wide[:-8] << np.uint64(56)
    for i in range(1, 8):
        window |= wide[i : len(wide) - 8 + i] << np.uint64(56 - 8 * i)
    # the first 8 bits tell an end of block, or 0; an interval that is read beyond its end is left to the caller
    short = ac[:: 1 << 8]
    end = np.where((short & 255 == 0) & (short >> 8 <= 8), short >> 8, 0).astype(np.int64)
    length_of, size_of = (dc >> 8).astype(np.uint64), (dc & 255).astype(np.uint64)
    size_of[dc == 0] = 15
    half, full = (1 << np.arange(16) >> 1), (1 << np.arange(16)) - 1
    values = np.empty((most, len(at)), np.int64)
    one, top = np.uint64(1), np.uint64(63)
    for done in range(most):
        bits = window[at >> 3] << (at & 7).astype(np.uint64)
        code = (bits >> np.uint64(48)).astype(np.int64)
        length, size = length_of[code], size_of[code]
        rest = bits << length
        extra = (rest >> one >> (top - size)).astype(np.int64)
        n = size.astype(np.int64)
        closing = end[(rest << size >> np.uint64(56)).astype(np.int64)]
        if not closing.all() or n.max() > 11 or (at > last).any():
            return done, at, np.cumsum(values[:done], axis=0)
        np.subtract(extra, full[n] * (extra < half[n]), out=values[done])
        at = at + (length.astype(np.int64) + n + closing)
    return most, at, np.cumsum(values, axis=0)


def _arranged(f: Frame, dc: np.ndarray) -> np.ndarray:
    across, down = f.units()
    first = [i for i, b in enumerate(f.layout()) if b[0] == 0]
    h, v = (f.parts[0][1], f.parts[0][2]) if len(f.scan) > 1 else (1, 1)
    grid = dc[: across * down, first].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    samples = (grid * f.quantisers[f.parts[0][3]] + 4 >> 3) + 128
    most_h, most_v = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
    wide, high = -(-(-(-f.width * f.parts[0][1] // most_h)) // 8), -(-(-(-f.height * f.parts[0][2] // most_v)) // 8)
    return np.clip(samples[:high, :wide], 0, 255).astype(np.uint8)


def block_means(thumb: np.ndarray, down: int, across: int) -> np.ndarray:
    """Means of down x across blocks that cover all samples; where there are fewer rows or columns, blocks are repeated."""
    rows, columns = np.arange(down) * thumb.shape[0] // down, np.arange(across) * thumb.shape[1] // across
    sums = np.add.reduceat(np.add.reduceat(thumb, rows, axis=0, dtype=np.int64), columns, axis=1)
    high, wide = (np.maximum(1, np.diff(at, append=n)) for at, n in ((rows, thumb.shape[0]), (columns, thumb.shape[1])))
    return sums / (high[:, None] * wide)


def thumbnail_hashes(thumb: np.ndarray) -> str:
    """Average hash (8 x 8 block means against their mean) and difference hash (9 x 8 block means against the right one)."""
    square, longer = block_means(thumb, 8, 8), block_means(thumb, 8, 9)
    return np.packbits(square * 64 > square.sum()).tobytes().hex() + np.packbits(longer[:, 1:] > longer[:, :-1]).tobytes().hex()


def describe(media: list[bytes]) -> list[tuple[str, np.ndarray]]:
    """(feature, thumbnail) of each file; images that follow one another are set below one another."""
    frames = [list(parse(m)) for m in media]
    thumbs = iter(thumbnails([f for own in frames for f in own]))
    out = []
    for own in frames:
        parts = [next(thumbs) for _ in own]
        thumb = parts[0] if len(parts) == 1 else np.concatenate(parts)
        out.append((f"{own[0].width}x{sum(f.height for f in own)}:{thumbnail_hashes(thumb)}", thumb))
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return len(data), data + b" " * ((-len(data)) % UNIT or (UNIT if not data else 0))


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Each text stored as JPEG and read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (dimensions and thumbnail hashes)[, media].

    docs: doc_id, text; further columns are ignored. Null counts as empty, and an empty text is stored as UNIT blanks. Equal
    texts give equal values; repeated rows stay. An empty table gives an empty one. Memory: about GROUP_BYTES of
    texts at a time, and a document.
    """

    def convert(group: list[tuple]) -> pd.DataFrame:
        sizes, payloads = zip(*(payload_of(t) for _, t in group), strict=True)
        media = [stored(p) for p in payloads]
        rows = []
        for (doc_id, _), n, m, (feature, thumb) in zip(group, sizes, media, describe(media), strict=True):
            back = thumb.tobytes()
            rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, *((m,) if with_media else ())))
        out = pd.DataFrame(rows, columns=names)
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            group, held = [], 0
            for doc_id, text in zip(b["doc_id"].astype("Int64"), b["text"], strict=True):
                group.append((doc_id, text))
                held += len(text or "")
                if held > GROUP_BYTES:
                    yield convert(group)
                    group, held = [], 0
            if group:
                yield convert(group)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", "text").mapInPandas(run, schema)
