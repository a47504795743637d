"""Progressive JPEG media: scans accumulate into coefficient arrays; numpy inverse transform; full-resolution RGB.

Decoder: any 8-bit Huffman-coded progressive JPEG of one or three components, with spectral selection, successive
approximation, end-of-band runs, restart markers and chroma subsampling by whole factors. Symbols are read one by one;
stretches of blocks that repeat one (code, size) pattern are tried as a matrix first, and the correction bits of
end-of-band runs are taken in one go. Both give what reading one by one gives.

Payload store: 64 payload bytes are the coefficients of a block (the format's unit), all in size category 8 but for the
DC, so that coding is lossless; quantisation tables are all ones. Blocks beyond the payload are byte 255; a comment
segment holds the payload's length.

Rows: null text is an empty payload before padding; a null id stays null, repeated rows get equal values, an empty table
gives no rows, other columns are ignored. The image is a strip of up to 4095 MCUs a row, so a payload may have up to
6 GB. A damaged or foreign stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices

UNIT = 576


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag place: diagonals, every other one upwards."""
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))
    return np.array([8 * y + x for y, x in order])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """64 x 64: what a zigzag coefficient adds to each sample, in 1/4096; integers, so sums of them are exact."""
    u = np.arange(8)
    c = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1.0)[:, None] / 2
    return np.rint(np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG] * 4096)


BASIS = _basis()

# ---- Huffman tables: (bits: number of codes of each length 1 to 16, symbols) ----

#: Twelve DC categories in four bits each.
DC_TABLE = (bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))
#: One bit for a size-7 coefficient without zeros before it, ten bits for every other symbol.
AC_TABLE = (bytes([1] + [0] * 8 + [255] + [0] * 6), bytes([7] + [i for i in range(256) if i != 7]))


@lru_cache(64)
def _codes(table: tuple[bytes, bytes]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length)."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[table[1][k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(64)
def _lookup(table: tuple[bytes, bytes]) -> list[int]:
    """For each 16 bits: 256 * code length + symbol, or 0."""
    out = np.zeros(1 << 16, np.int64)
    for symbol, (code, length) in _codes(table).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = 256 * length + symbol
    return out.tolist()


class _Bits:
    """Bits of an entropy-coded segment without stuffing; ones follow its end."""

    def __init__(self, data: bytes):
        self.size = 8 * len(data)
        self.data = data + b"\xff" * 8
        self.at = 0

    def peek16(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def symbol(self, lookup: list[int]) -> int:
        found = lookup[self.peek16()]
        if not found or self.at > self.size:
            raise ValueError("damaged entropy-coded data")
        self.at += found >> 8
        return found & 255

    def take(self, n: int) -> int:
        if not n:
            return 0
        i = self.at >> 3
        value = int.from_bytes(self.data[i : i + 4], "big") >> (32 - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        return value

    def many(self, n: int) -> np.ndarray:
        """The next n bits as an array."""
        first, skip = self.at >> 3, self.at & 7
        if self.at + n > self.size:
            raise ValueError("entropy-coded data end too early")
        part = np.frombuffer(self.data, np.uint8, (skip + n + 7) // 8, first)
        self.at += n
        return np.unpackbits(part)[skip : skip + n]


def _extend(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _uniform(bits: _Bits, lookup: list[int], out: np.ndarray, low: int, blocks: int) -> int:
    """Read whole blocks whose symbols are all the next one, a coefficient without zeros before it; how many."""
    found = lookup[bits.peek16()]
    length, symbol = found >> 8, found & 255
    size, band = symbol & 15, out.shape[1]
    if not found or symbol >> 4 or not size:
        return 0
    step = length + size
    blocks = min(blocks, (bits.size - bits.at) // (step * band))
    if blocks <= 0:
        return 0
    if step == 8 and not bits.at & 7:
        raw = np.frombuffer(bits.data, np.uint8, blocks * band, bits.at >> 3)
        same = raw >> size == bits.peek16() >> (16 - length)
        value = (raw & ((1 << size) - 1)).astype(np.int32)
    else:
        at = bits.at
        cells = bits.many(blocks * band * step).reshape(-1, step)
        bits.at = at
        same = (cells[:, :length] == cells[0, :length]).all(1)
        value = cells[:, length:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
    good = blocks if same.all() else int(np.argmin(same)) // band
    value = value[: good * band]
    out[:good] = np.where(value >> (size - 1), value, value - (1 << size) + 1).reshape(good, band) << low
    bits.at += good * band * step
    return good


def _ac_first(bits: _Bits, out: np.ndarray, table, low: int, fast: bool) -> None:
    """out: blocks x band."""
    lookup = _lookup(table)
    n, band = out.shape
    block, reach = 0, 4
    while block < n:
        if fast and (good := _uniform(bits, lookup, out[block:], low, min(n - block, reach))):
            block += good
            reach *= 8
            continue
        reach, k = 4, 0
        while k < band:
            symbol = bits.symbol(lookup)
            run, size = symbol >> 4, symbol & 15
            if size:
                k += run
                if k >= band:
                    raise ValueError("coefficient beyond its band")
                out[block, k] = _extend(bits.take(size), size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                block += (1 << run) + bits.take(run) - 1
                break
        block += 1


def _correct(bits: _Bits, part: np.ndarray, low: int) -> None:
    """Correction bits for all non-zero coefficients of an array, in order."""
    flat = part.reshape(-1)
    at = np.flatnonzero(flat)
    if len(at):
        value = flat[at]
        flat[at] = value + np.sign(value) * (bits.many(len(at)).astype(flat.dtype) << low)
        if flat.base is not part and not np.shares_memory(flat, part):
            part[...] = flat.reshape(part.shape)


def _ac_refine(bits: _Bits, out: np.ndarray, table, low: int) -> None:
    lookup = _lookup(table)
    n, band = out.shape
    one, block = 1 << low, 0
    while block < n:
        k = 0
        while k < band:
            symbol = bits.symbol(lookup)
            run, size = symbol >> 4, symbol & 15
            if not size and run < 15:
                more = (1 << run) + bits.take(run)
                if block + more > n:
                    raise ValueError("end-of-band run beyond the scan")
                rest = out[block, k:].copy()
                _correct(bits, rest, low)
                out[block, k:] = rest
                if more > 1:
                    rest = np.ascontiguousarray(out[block + 1 : block + more])
                    _correct(bits, rest, low)
                    out[block + 1 : block + more] = rest
                block += more - 1
                break
            new = (one if bits.take(1) else -one) if size else 0
            while k < band:
                v = int(out[block, k])
                if v:
                    if bits.take(1):
                        out[block, k] = v + (one if v > 0 else -one)
                elif run:
                    run -= 1
                else:
                    break
                k += 1
            if k < band:
                out[block, k] = new
            k += 1
        block += 1


class Image:
    """A decoded file: zigzag coefficients of each component, and what is needed to make samples of them."""

    def __init__(self, width: int, height: int, parts: list[dict]):
        self.width, self.height, self.parts = width, height, parts
        self.hmax, self.vmax = max(p["h"] for p in parts), max(p["v"] for p in parts)
        if any(self.hmax % p["h"] or self.vmax % p["v"] for p in parts):
            raise ValueError("only whole subsampling factors are supported")
        self.mcus = (-(-height // (8 * self.vmax)), -(-width // (8 * self.hmax)))
        for p in parts:
            p["coefs"] = np.zeros((self.mcus[0] * p["v"], self.mcus[1] * p["h"], 64), np.int32)
            p["own"] = (-(-(-(-height * p["v"] // self.vmax)) // 8), -(-(-(-width * p["h"] // self.hmax)) // 8))
        self.comment = b""

    def rgb(self) -> np.ndarray:
        """Full-resolution samples, height x width x 3; chroma is repeated to the luma's grid."""
        planes = []
        for p in self.parts:
            rows, cols, _ = p["coefs"].shape
            quant = p["quant"]
            samples = np.floor(p["coefs"].reshape(-1, 64).astype(np.float64) @ (BASIS * quant[:, None]) / 4096 + 128.5)
            plane = np.clip(samples, 0, 255).astype(np.uint8).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
            up = (self.vmax // p["v"], self.hmax // p["h"])
            planes.append(plane.repeat(up[0], 0).repeat(up[1], 1)[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][..., None], 3, 2)
        y, cb, cr = planes[0].astype(np.int32), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
        # Conversion of JFIF in 1/65536.
        red = y + ((91881 * cr + 32768) >> 16)
        green = y - ((22554 * cb + 46802 * cr + 32768) >> 16)
        blue = y + ((116130 * cb + 32768) >> 16)
        return np.clip(np.stack([red, green, blue], -1), 0, 255).astype(np.uint8)


_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]", re.S)


def decode(data: bytes, fast: bool = True) -> Image:
    """Decode a progressive JPEG. fast=False reads symbol by symbol only."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, tuple[bytes, bytes]] = {}
    image, restart, at, comment = None, 0, 2, b""
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif kind == 0xC2:
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n not in (1, 3) or not width or not height:
                raise ValueError("8-bit images of one or three components only")
            image = Image(width, height, [{"id": c, "h": hv >> 4, "v": hv & 15, "tq": tq} for c, hv, tq in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])])
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            comment += bytes(body)
        elif kind == 0xDA:
            if image is None:
                raise ValueError("scan before frame")
            end = _END.search(data, at)
            stop = end.start() if end else len(data)
            _scan(image, body, data[at:stop], tables, restart, fast)
            at = stop
        elif kind in (0xC0, 0xC1, 0xC3) or 0xC5 <= kind <= 0xCF:
            raise ValueError("only progressive Huffman-coded images")
    if image is None:
        raise ValueError("no frame")
    for p in image.parts:
        p["quant"] = quant[p["tq"]]
    image.comment = comment
    return image


def _scan(image: Image, head: bytes, raw: bytes, tables, restart: int, fast: bool) -> None:
    n = head[0]
    by_id = {p["id"]: p for p in image.parts}
    chosen = [(by_id[c], t) for c, t in struct.iter_unpack("BB", head[1 : 1 + 2 * n])]
    first, last, approx = head[1 + 2 * n : 4 + 2 * n]
    high, low = approx >> 4, approx & 15
    pieces = (_RESTART.split(raw) if restart else [raw]) if raw else [b""]
    pieces = [x.replace(b"\xff\x00", b"\xff") for x in pieces]
    if n == 1:
        part = chosen[0][0]
        rows, cols = part["own"]
        flat = None
        if first:
            area = part["coefs"][:rows, :cols]
            flat = np.ascontiguousarray(area[..., first : last + 1]).reshape(rows * cols, last - first + 1)
            table = tables[0x10 | chosen[0][1] & 15]
            step = restart or len(flat)
            for i, piece in enumerate(pieces):
                own = flat[i * step : (i + 1) * step]
                if high:
                    _ac_refine(_Bits(piece), own, table, low)
                else:
                    _ac_first(_Bits(piece), own, table, low, fast)
            area[..., first : last + 1] = flat.reshape(rows, cols, -1)
            return
        grids = [(part, np.arange(rows * cols).reshape(rows * cols, 1), cols, chosen[0][1] >> 4)]
        units = rows * cols
    else:
        if first:
            raise ValueError("AC scans have one component")
        units = image.mcus[0] * image.mcus[1]
        grids = []
        for part, t in chosen:
            v, h = part["v"], part["h"]
            cols = image.mcus[1] * h
            order = np.arange(image.mcus[0] * v * cols).reshape(image.mcus[0], v, image.mcus[1], h).transpose(0, 2, 1, 3)
            grids.append((part, order.reshape(units, v * h), cols, t >> 4))
    # DC: the blocks of all units in coding order.
    which = np.concatenate([np.full(g[1].shape[1], i) for i, g in enumerate(grids)]).tolist()
    per = len(which)
    step = restart or units
    values = np.zeros((units, per), np.int64)
    for i, piece in enumerate(pieces):
        bits, begin, end = _Bits(piece), i * step, min((i + 1) * step, units)
        if high:
            values[begin:end] = bits.many((end - begin) * per).reshape(-1, per)
            continue
        lookups = [_lookup(tables[g[3]]) for g in grids]
        before, got = [0] * len(grids), []
        for _ in range(end - begin):
            for c in which:
                size = bits.symbol(lookups[c])
                before[c] += _extend(bits.take(size), size)
                got.append(before[c])
        values[begin:end] = np.array(got, np.int64).reshape(-1, per)
    col = 0
    for part, order, cols, _ in grids:
        width = order.shape[1]
        own = (values[:, col : col + width] << low).ravel()
        col += width
        place = order.ravel()
        y, x = np.divmod(place, cols)
        if high:
            part["coefs"][y, x, 0] |= own.astype(np.int32)
        else:
            part["coefs"][y, x, 0] = own


# ---- encoder ----


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _stuffed(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.r_[bits, np.ones(pad, np.uint8)]).tobytes().replace(b"\xff", b"\xff\x00")


def _coded(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bits of values of given lengths, one after another."""
    most = int(lengths.max()) if len(lengths) else 0
    shift = lengths[:, None] - 1 - np.arange(most)[None, :]
    cells = (values[:, None] >> np.maximum(shift, 0)) & 1
    return cells[shift >= 0].astype(np.uint8)


def _categories(diff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    return size, np.where(diff < 0, diff + (1 << size) - 1, diff)


@lru_cache(4096)
def _end_runs(n: int) -> bytes:
    """Bits ('0' and '1') of the first end-of-band symbol for n blocks; n is at most 32767."""
    size = n.bit_length() - 1
    code, length = _codes(AC_TABLE)[size << 4]
    return (format(code, f"0{length}b") + (format(n - (1 << size), f"0{size}b") if size else "")).encode()


_HEAD = {}


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG (4:2:0, nine scans) whose coefficients are the payload's bytes."""
    mcus = max(1, -(-len(payload) // 384))
    cols = min(mcus, 4095)
    rows = -(-mcus // cols)
    total = rows * cols
    if rows > 4095:
        raise ValueError("the payload is too large for one image")
    data = np.frombuffer(payload.ljust(total * 384, b"\xff"), np.uint8)
    luma, cb, cr = data[: total * 256].reshape(-1, 64), data[total * 256 : total * 320].reshape(-1, 64), data[total * 320 :].reshape(-1, 64)
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload)))]
    out.append(_segment(0xDB, b"\x00" + b"\x01" * 64))
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_segment(0xC4, b"\x00" + DC_TABLE[0] + DC_TABLE[1]) + _segment(0xC4, b"\x10" + AC_TABLE[0] + AC_TABLE[1]))
    dc = [x[:, 0].astype(np.int64) - 128 for x in (luma, cb, cr)]
    dc[0] = dc[0].reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(-1)
    diffs = np.c_[np.diff(dc[0] >> 1, prepend=0).reshape(total, 4), np.diff(dc[1] >> 1, prepend=0), np.diff(dc[2] >> 1, prepend=0)].ravel()
    size, extra = _categories(diffs)
    inter = bytes([3, 1, 0, 2, 0, 3, 0])
    out += [_segment(0xDA, inter + bytes([0, 0, 0x01])), _stuffed(_coded(size << size | extra, size + 4))]
    for c, blocks, first, last in ((1, luma, 1, 5), (1, luma, 6, 63), (2, cb, 1, 63), (3, cr, 1, 63)):
        # The code is a zero bit, the coefficient's upper half follows it: a byte below 128, so nothing is stuffed.
        out += [_segment(0xDA, bytes([1, c, 0, first, last, 0x01])), (blocks[:, first : last + 1] >> 1).tobytes()]
    for c, blocks in ((1, luma), (2, cb), (3, cr)):
        bits = (blocks[:, 1:] & 1) ^ (blocks[:, 1:] < 128)
        parts = []
        for i in range(0, len(blocks), 32767):
            own = bits[i : i + 32767]
            parts += [np.frombuffer(_end_runs(len(own)), np.uint8) & 1, own.ravel()]
        out += [_segment(0xDA, bytes([1, c, 0, 1, 63, 0x10])), _stuffed(np.concatenate(parts))]
    low = np.c_[(dc[0] & 1).reshape(total, 4), dc[1] & 1, dc[2] & 1].astype(np.uint8).ravel()
    out += [_segment(0xDA, inter + bytes([0, 0, 0x10])), _stuffed(low), b"\xff\xd9"]
    return b"".join(out)


def payload_of(image: Image) -> bytes:
    """The payload that encode_payload stored."""
    size = struct.unpack(">Q", image.comment[:8])[0]
    coefs = np.concatenate([p["coefs"].reshape(-1, 64) for p in image.parts])
    data = np.where(coefs < 0, coefs + 255, coefs)
    data[:, 0] = coefs[:, 0] + 128
    return data.astype(np.uint8).tobytes()[:size]


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


# ---- DataFrame operators ----


def store_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media (binary): the UTF-8 text, padded to units with bytes 255, as a progressive JPEG."""

    def run(batches):
        for part in slices(batches, rows=256):
            media = [encode_payload(padded(t or b"")) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, media binary")


def decode_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, height, width and rgb (binary, height x width x 3 bytes) of each file; null media give nulls."""

    def run(batches):
        for part in slices(batches, rows=64):
            got = [None if m is None else decode(m).rgb() for m in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *(pa.array([None if g is None else g.shape[k] for g in got], pa.int32()) for k in (0, 1)),
                    pa.array([None if g is None else g.tobytes() for g in got], pa.binary()),
                ],
                ["doc_id", "height", "width", "rgb"],
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col)).mapInArrow(run, "doc_id long, height int, width int, rgb binary")


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel in 1/1000, checksum of the tensor."""
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (rgb.size // 3)
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{'/'.join(map(str, sums.tolist()))}:{zlib.crc32(rgb):08x}"


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media -> what the stored files say: payload and media digests and the tensor's feature."""

    def run(batches):
        for part in slices(batches, rows=256):
            cols: list[list] = [[] for _ in range(6)]
            for raw in part.column(2).to_pylist():
                image = decode(raw)
                payload = payload_of(image)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(image.rgb()))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, cols)], [x.split()[0] for x in _DIGEST.split(", ")])

    return media.mapInArrow(run, _DIGEST)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for part in slices(batches, rows=256):
            texts = [t or b"" for t in part.column(1).to_pylist()]
            media = [encode_payload(padded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return media_digests(docs.mapInArrow(run, "doc_id long, n_bytes long, media binary"))
