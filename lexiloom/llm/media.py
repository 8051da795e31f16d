"""Media columns: progressive JPEG.

``decode`` reads progressive JPEG: it accumulates the scans of spectral selection and successive approximation into coefficient
arrays, inverts the transform in numpy with integer weights (exact sums, so equal images give equal pixels wherever they
stand in a batch), upsamples chroma and gives full-resolution RGB tensors. Scans whose symbols all have one length in whole
bits are read as arrays, for a batch of images at once; any other scan symbol by symbol.

``encode`` stores bytes without loss: a byte is the quantised coefficient byte + 256, 64 to a block, the blocks of Y, Cb
and Cr one after the other at half chroma resolution, missing blocks filled with spaces. Six scans for each component: DC and AC (two
bands) without their low bits, then one bit more at a time.

Defined results: null text is empty, which is 192 bytes of spaces; texts of any length become images of up to MOST_WIDE
units a row; repeated rows give equal values; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_lists

UNIT, PAD = 192, 32
OFFSET = 256
MOST_WIDE = 4000
#: Payload bytes that are coded and decoded together.
BATCH_BYTES = 1 << 20


def _zigzag() -> np.ndarray:
    """Natural place of each coefficient in zigzag order."""
    cells = sorted(((x + y, x if (x + y) % 2 == 0 else y, y * 8 + x) for y in range(8) for x in range(8)))
    return np.array([c[2] for c in cells])


ZIGZAG = _zigzag()
SHIFT = 20
_C = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Rows: natural coefficients, columns: samples; integers, so that float64 sums are exact.
INVERSE = np.rint(np.kron(_C, _C) * (1 << SHIFT))


@dataclass
class Table:
    """A Huffman table: counts for lengths 1 to 16 and symbols."""

    counts: bytes
    symbols: bytes
    codes: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        code, k = 0, 0
        for length in range(1, 17):
            for _ in range(self.counts[length - 1]):
                self.codes[length, code] = self.symbols[k]
                code, k = code + 1, k + 1
            code <<= 1

    def of(self, symbol: int) -> tuple[int, int]:
        """(length, code) of a symbol."""
        return next(x for x, s in self.codes.items() if s == symbol)


def _table_of(lengths: dict[int, int]) -> Table:
    """From the length of each symbol's code."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return Table(bytes(sum(lengths[s] == n for s in order) for n in range(1, 17)), bytes(order))


#: A difference of category s has a code of 16 - s bits, so every DC symbol takes 16 bits with its magnitude.
DC_TABLE = _table_of({s: 16 - s for s in range(10)})
AC_TABLE = _table_of({0x07: 1})
REFINE_TABLE = _table_of({0x00: 1})


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int) -> bytes:
    tables = b"".join(bytes([at]) + t.counts + t.symbols for at, t in ((0x00, DC_TABLE), (0x10, AC_TABLE), (0x11, REFINE_TABLE)))
    jfif = _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + jfif + _segment(0xDB, b"\0" + b"\x01" * 64) + _segment(0xC2, frame) + _segment(0xC4, tables)


def _scan_head(component: int, low: int, high: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([1, component + 1, 0x01 if ah and low else 0x00, low, high, ah << 4 | al]))


SCANS = ((0, 0, 0, 1), (1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (1, 63, 1, 0), (0, 0, 1, 0))


def layout(payload: int) -> tuple[int, int]:
    """MCUs a row and rows for so many payload bytes."""
    mcus = -(-payload // 384)
    wide = min(mcus, MOST_WIDE)
    return wide, -(-mcus // wide)


def encode(payloads: list[bytes]) -> list[bytes]:
    """One JPEG for each payload (a positive multiple of UNIT bytes)."""
    shapes = [layout(len(p)) for p in payloads]
    filled = b"".join(p.ljust(384 * w * h, bytes([PAD])) for p, (w, h) in zip(payloads, shapes, strict=True))
    values = np.frombuffer(filled, np.uint8).reshape(-1, 64).astype(np.int32) + OFFSET
    blocks = np.array([6 * w * h for w, h in shapes])
    first = np.cumsum(blocks) - blocks
    # DC differences run within a component of an image
    fresh = np.concatenate([first, first + blocks // 6 * 4, first + blocks // 6 * 5])
    dc = values[:, 0] >> 1
    diff = np.diff(dc, prepend=0)
    diff[fresh] = dc[fresh]
    size = np.where(diff == 0, 0, np.frexp(np.abs(diff).astype(float))[1])
    codes = np.array([DC_TABLE.of(s)[1] for s in range(10)])
    dc_first = (codes[size] << size | np.where(diff < 0, diff + (1 << size) - 1, diff)).astype(">u2").view(np.uint8).reshape(-1, 2)
    ac = (values >> 2).astype(np.uint8)  # the code 0, then 7 bits
    bit = lambda n: np.packbits(np.concatenate([np.zeros((len(values), 1), np.uint8), (values[:, 1:] >> n & 1).astype(np.uint8)], axis=1), axis=1)
    streams = [dc_first, np.ascontiguousarray(ac[:, 1:6]), np.ascontiguousarray(ac[:, 6:]), bit(1), bit(0)]
    raw = [(s.shape[1], s.tobytes()) for s in streams]
    low = (values[:, 0] & 1).astype(np.uint8)
    out = []
    for start, (w, h) in zip(first.tolist(), shapes, strict=True):
        parts, at = [_head(16 * w, 16 * h)], start
        for component, n in enumerate((4 * w * h, w * h, w * h)):
            for (bottom, top, ah, al), (width, data) in zip(SCANS, [*raw, (0, b"")], strict=True):
                bits = low[at : at + n]
                body = data[at * width : (at + n) * width] if width else np.packbits(np.concatenate([bits, np.ones(-n % 8, np.uint8)])).tobytes()
                parts += [_scan_head(component, bottom, top, ah, al), body.replace(b"\xff", b"\xff\0")]
            at += n
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


@dataclass
class Scan:
    components: list[tuple[int, int, int]]  # (index in the frame, DC table, AC table)
    low: int
    high: int
    ah: int
    al: int
    tables: dict[int, Table]
    restart: int
    data: list[bytes]  # by restart interval, without stuffing


@dataclass
class Image:
    width: int
    height: int
    sampling: list[tuple[int, int]]
    quant: list[np.ndarray]
    scans: list[Scan]

    def blocks(self, c: int) -> tuple[int, int]:
        """Blocks a row and rows of a component, as scans of that component alone have them."""
        (h, v), hm, vm = self.sampling[c], max(s[0] for s in self.sampling), max(s[1] for s in self.sampling)
        return -(-(-(-self.width * h // hm)) // 8), -(-(-(-self.height * v // vm)) // 8)

    def padded(self, c: int) -> tuple[int, int]:
        (h, v), hm, vm = self.sampling[c], max(s[0] for s in self.sampling), max(s[1] for s in self.sampling)
        return -(-self.width // (8 * hm)) * h, -(-self.height // (8 * vm)) * v


_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_tables_seen: dict[bytes, dict[int, Table]] = {}


def _tables(body: bytes) -> dict[int, Table]:
    if body not in _tables_seen:
        out, at = {}, 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            out[body[at]] = Table(counts, body[at + 17 : at + 17 + n])
            at += 17 + n
        _tables_seen.clear() if len(_tables_seen) > 1000 else None
        _tables_seen[body] = out
    return _tables_seen[body]


def parse(data: bytes) -> Image:
    """Frame and scans of a progressive file."""
    at, quant, tables, restart = 2, {}, {}, 0
    image, ids, tq = None, [], []
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker == 0xFF:
            at += 1
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quant[body[i] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.int64)
                i += 1 + 64 * (1 + wide)
        elif marker == 0xC2:
            height, width, n = struct.unpack(">HHB", body[1:6])
            ids = [body[6 + 3 * i] for i in range(n)]
            tq = [body[8 + 3 * i] for i in range(n)]
            image = Image(width, height, [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)], [], [])
        elif marker in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive JPEG")
        elif marker == 0xC4:
            tables = tables | _tables(body)
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            n = body[0]
            parts = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            found = _END.search(data, at)
            end = found.start() if found else len(data)
            pieces = _RESTART.split(data[at:end]) if restart else [data[at:end]]
            low, high, a = body[1 + 2 * n : 4 + 2 * n]
            image.scans.append(Scan(parts, low, high, a >> 4, a & 15, tables, restart, [p.replace(b"\xff\0", b"\xff") for p in pieces]))
            at = end
    image.quant = [quant[q] for q in tq]
    return image


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.concatenate([np.unpackbits(np.frombuffer(data, np.uint8)), np.ones(64, np.uint8)]).tolist()
        self.at = 0

    def read(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bits[self.at]
            self.at += 1
        return out

    def symbol(self, table: Table) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if (s := table.codes.get((length, code))) is not None:
                return s
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _read_scan(image: Image, scan: Scan, coefficients: list[np.ndarray]) -> None:
    """Any scan, symbol by symbol. coefficients: (rows, columns, 64) for each component, zigzag."""
    units: list[list[tuple[int, int, int]]] = []
    if len(scan.components) == 1:
        c = scan.components[0][0]
        wide, high = image.blocks(c)
        units = [[(0, y, x)] for y in range(high) for x in range(wide)]
    else:
        wide, high = (image.padded(0)[i] // image.sampling[0][i] for i in (0, 1))
        for my in range(high):
            for mx in range(wide):
                units.append([(i, my * v + y, mx * h + x) for i, (c, _, _) in enumerate(scan.components) for h, v in [image.sampling[c]] for y in range(v) for x in range(h)])
    step = scan.restart or len(units)
    one = 1 << scan.al
    for piece, start in zip(scan.data, range(0, len(units), step), strict=False):
        bits, run, last = _Bits(piece), 0, [0] * len(scan.components)
        for unit in units[start : start + step]:
            for i, y, x in unit:
                c, dc, ac = scan.components[i]
                block = coefficients[c][y, x]
                if scan.low == 0:
                    if scan.ah:
                        block[0] |= bits.read(1) << scan.al
                    else:
                        last[i] += bits.signed(bits.symbol(scan.tables[dc]))
                        block[0] = last[i] << scan.al
                    continue
                table, k = scan.tables[0x10 | ac], scan.low
                if not scan.ah:
                    if run:
                        run -= 1
                        continue
                    while k <= scan.high:
                        s = bits.symbol(table)
                        r, size = s >> 4, s & 15
                        if size:
                            k += r
                            block[k] = bits.signed(size) * one
                            k += 1
                        elif r == 15:
                            k += 16
                        else:
                            run = (1 << r) - 1 + bits.read(r)
                            break
                    continue

                def correct(k: int) -> None:
                    if bits.read(1) and not abs(int(block[k])) & one:  # noqa: B023
                        block[k] += one if block[k] > 0 else -one  # noqa: B023

                if not run:
                    while k <= scan.high:
                        s = bits.symbol(table)
                        r, size = s >> 4, s & 15
                        value = 0
                        if size:
                            value = one if bits.read(1) else -one
                        elif r < 15:
                            run = (1 << r) + bits.read(r)
                            break
                        while k <= scan.high:
                            if block[k]:
                                correct(k)
                            elif r:
                                r -= 1
                            else:
                                break
                            k += 1
                        if value and k <= scan.high:
                            block[k] = value
                        k += 1
                if run:
                    while k <= scan.high:
                        if block[k]:
                            correct(k)
                        k += 1
                    run -= 1


def _read_even(scans: list[Scan], held: np.ndarray, n: list[int]) -> bool:
    """One scan of many images, of one component each, if every symbol takes the same whole number of bits.

    held: the component's blocks of all images, zigzag, n of them for each. False, with nothing changed, if it is uneven.
    """
    s = scans[0]
    low, high, one = s.low, s.high, 1 << s.al
    if any(x.tables is not s.tables and {k: (t.counts, t.symbols) for k, t in x.tables.items()} != {k: (t.counts, t.symbols) for k, t in s.tables.items()} for x in scans[1:]):
        return False
    table = s.tables.get(s.components[0][1] if low == 0 else 0x10 | s.components[0][2])
    if low == 0 and s.ah:
        sizes = [-(-x // 8) for x in n]
        if any(len(x.data[0]) != k for x, k in zip(scans, sizes, strict=True)):
            return False
        bits = np.unpackbits(np.frombuffer(b"".join(x.data[0] for x in scans), np.uint8))
        starts = 8 * (np.cumsum(sizes) - sizes)
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(sum(n))
        held[:, 0] |= bits[at].astype(held.dtype) << s.al
        return True
    if low == 0:
        totals = {length + symbol for (length, _), symbol in table.codes.items()}
        if totals != {16} or any(len(x.data[0]) != 2 * k for x, k in zip(scans, n, strict=True)):
            return False
        words = np.frombuffer(b"".join(x.data[0] for x in scans), ">u2").astype(np.int64)
        lookup = np.full(1 << 16, 1 << 30, np.int64)
        for (length, code), size in table.codes.items():
            v = np.arange(1 << size)
            lookup[(code << size) + v] = np.where(v >> max(size - 1, 0) > 0, v, v - (1 << size) + 1) if size else 0
        diff = lookup[words]
        if (diff == 1 << 30).any():
            return False
        total = np.cumsum(diff)
        before = np.concatenate([[0], total])[np.cumsum(n) - n]
        held[:, 0] = (total - np.repeat(before, n)) << s.al
        return True
    count = high - low + 1
    if len(table.codes) != 1:
        return False
    ((length, code), symbol), = table.codes.items()
    if s.ah:  # all coefficients nonzero, so a block is its end-of-block code and one bit for each coefficient
        if symbol or (length + count) % 8 or not held[:, low : high + 1].all():
            return False
        wide = (length + count) // 8
    else:
        if symbol >> 4 or length + (symbol & 15) != 8:
            return False
        wide = count
    if any(len(x.data[0]) != wide * k for x, k in zip(scans, n, strict=True)):
        return False
    raw = np.frombuffer(b"".join(x.data[0] for x in scans), np.uint8).reshape(-1, wide)
    if s.ah:
        bits = np.unpackbits(raw, axis=1)
        if (bits[:, :length] @ (1 << np.arange(length)[::-1]) != code).any():
            return False
        band = held[:, low : high + 1]
        band += np.where(bits[:, length:] > 0, np.sign(band) * one, 0) * (np.abs(band) & one == 0)
        return True
    size = symbol & 15
    if (raw >> size != code).any():
        return False
    v = (raw & ((1 << size) - 1)).astype(held.dtype)
    held[:, low : high + 1] = np.where(v >> (size - 1) > 0, v, v - (1 << size) + 1) * one
    return True


def accumulate(files: list[bytes]) -> list[tuple[Image, list[np.ndarray]]]:
    """Images with their coefficient arrays, (rows, columns, 64) in zigzag order for each component."""
    images = [parse(f) for f in files]
    out = [(i, [np.zeros((h, w, 64), np.int32) for w, h in (i.padded(c) for c in range(len(i.sampling)))]) for i in images]
    groups: dict[tuple, list[int]] = {}
    for k, i in enumerate(images):
        alike = all(len(s.components) == 1 and len(s.data) == 1 for s in i.scans) and all(i.blocks(c) == i.padded(c) for c in range(len(i.sampling)))
        groups.setdefault(tuple((s.components[0], s.low, s.high, s.ah, s.al) for s in i.scans) if alike else k, []).append(k)
    for key, members in groups.items():
        if isinstance(key, int):
            for s in images[key].scans:
                _read_scan(images[key], s, out[key][1])
            continue
        n = {c: [images[k].blocks(c)[0] * images[k].blocks(c)[1] for k in members] for c in range(len(images[members[0]].sampling))}
        held = {c: np.zeros((sum(x), 64), np.int32) for c, x in n.items()}
        for at in range(len(key)):
            c = key[at][0][0]
            if not _read_even([images[k].scans[at] for k in members], held[c], n[c]):
                start = 0
                for k, count in zip(members, n[c], strict=True):
                    w, h = images[k].blocks(c)
                    part = [None] * len(n)
                    part[c] = held[c][start : start + count].reshape(h, w, 64)
                    _read_scan(images[k], images[k].scans[at], part)
                    start += count
        for c, counts in n.items():
            start = 0
            for k, count in zip(members, counts, strict=True):
                out[k][1][c] = held[c][start : start + count].reshape(out[k][1][c].shape)
                start += count
    return out


def _samples(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8 x 8 samples (unsigned 8-bit) of zigzag blocks."""
    natural = np.zeros((len(blocks), 64))
    natural[:, ZIGZAG] = blocks * quant
    return np.clip(np.floor((natural @ INVERSE + (1 << (SHIFT - 1))) * 2.0**-SHIFT) + 128, 0, 255).astype(np.uint8)


def _plane(samples: np.ndarray, high: int, wide: int) -> np.ndarray:
    return samples.reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * high, 8 * wide)


def tensors(read: list[tuple[Image, list[np.ndarray]]]) -> list[np.ndarray]:
    """Full-resolution RGB, (height, width, 3) of unsigned 8-bit; one component gives three equal channels."""
    flat = [(c.reshape(-1, 64), np.broadcast_to(i.quant[k], (c.shape[0] * c.shape[1], 64))) for i, cs in read for k, c in enumerate(cs)]
    samples = _samples(np.concatenate([f[0] for f in flat]), np.concatenate([f[1] for f in flat])) if flat else np.zeros((0, 64), np.uint8)
    out, at = [], 0
    for image, components in read:
        planes = []
        hm, vm = max(s[0] for s in image.sampling), max(s[1] for s in image.sampling)
        for k, c in enumerate(components):
            n = c.shape[0] * c.shape[1]
            plane = _plane(samples[at : at + n], *c.shape[:2])
            at += n
            h, v = image.sampling[k]
            plane = np.repeat(np.repeat(plane, vm // v, axis=0), hm // h, axis=1)  # upsampled by replication
            planes.append(plane[: image.height, : image.width])
        if len(planes) == 1:
            out.append(np.stack(planes * 3, axis=2))
            continue
        y, cb, cr = (p.astype(np.int32) for p in planes[:3])
        cb, cr, half = cb - 128, cr - 128, 1 << 15
        rgb = np.stack([y + ((91881 * cr + half) >> 16), y - ((22554 * cb + 46802 * cr + half) >> 16), y + ((116130 * cb + half) >> 16)], axis=2)
        out.append(np.clip(rgb, 0, 255).astype(np.uint8))
    return out


def payload_of(image: Image, components: list[np.ndarray], size: int) -> bytes:
    """The first size bytes stored by encode."""
    flat = np.concatenate([c.reshape(-1) for c in components])[:size] - OFFSET
    return flat.astype(np.uint8).tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, channel sums and a checksum of a tensor."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + ",".join(map(str, sums.tolist())) + f":{zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def padded_payload(raw: bytes) -> bytes:
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), bytes([PAD]))


def _grouped(batches: Iterator[dict]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        keys, raws, size = [], [], 0
        for key, text in zip(batch["doc_id"], batch["text"], strict=True):
            keys.append(key)
            raws.append((text or "").encode("utf-8", "replace"))
            size += len(raws[-1]) + UNIT
            if size >= BATCH_BYTES:
                yield keys, raws
                keys, raws, size = [], [], 0
        if keys:
            yield keys, raws


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as a progressive JPEG."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for keys, raws in _grouped(batches):
            yield {"doc_id": keys, "n_bytes": [len(r) for r in raws], "media": encode([padded_payload(r) for r in raws])}

    return map_lists(_texts(docs), run, "doc_id long, n_bytes long, media binary")


def rgb(files: DataFrame, column: str = "media") -> DataFrame:
    """files with height, width and rgb (row-major bytes) for the JPEG in column; columns of these names give way."""
    from pyspark.sql import types as T

    files = files.drop("height", "width", "rgb")
    schema = T.StructType([*files.schema.fields, T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())])
    place = files.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = tensors(accumulate(batch.column(place).to_pylist()))
            more = [pa.array([x.shape[0] for x in got], pa.int32()), pa.array([x.shape[1] for x in got], pa.int32()), pa.array([x.tobytes() for x in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "height", "width", "rgb"])

    return files.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Stores, reads back and measures: the digest columns of every row."""
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for keys, raws in _grouped(batches):
            payloads = [padded_payload(r) for r in raws]
            files = encode(payloads)
            read = accumulate(files)
            rows = []
            for key, raw, payload, file, (image, components), pixels in zip(keys, raws, payloads, files, read, tensors(read), strict=True):
                back = payload_of(image, components, len(payload))
                rows.append((key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature(pixels)))
            yield dict(zip(names, zip(*rows, strict=True), strict=True))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_lists(_texts(docs), run, schema)
