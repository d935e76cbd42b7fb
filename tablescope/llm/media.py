"""Media columns: progressive JPEG read into coefficient arrays and full-resolution RGB tensors.

`decode` takes any Huffman-coded progressive JPEG of 8-bit precision with one to four components and any sampling factors:
the scans' spectral selection and successive approximation accumulate in one coefficient array for each component, which
is then dequantised, inverse-transformed in numpy, upsampled and converted.

`encode_payload` stores bytes without loss as such a file: a byte b is the quantised coefficient 256 + b, the format's
unit; 64 of them are a block, and a block of each of the three components a unit of 192 bytes. Every coefficient then
has the same magnitude category in the first scans and is known to be non-zero in the later ones, so that codes have one
width and a scan is written and read by reshaping its bits. Reading so is not assumed but proved from the file: if the
code found at each place where it is expected is that same code, then decoding one symbol after another would have given
the same (`_even`); any other scan is decoded one symbol after another.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

UNIT = 192
FILL = 32
#: Added to a payload byte: all coefficients lie in 256 to 511.
SHIFT = 256
#: Units in a row of blocks at most: a side of a JPEG has at most 65,535 samples.
WIDEST = 8191
#: Payload bytes of a file; longer payloads are several files.
PART = UNIT * 8192
TAG = b"PAYLOAD\0"
FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@lru_cache
def zigzag() -> np.ndarray:
    """Row * 8 + column of each coefficient in the order of the format: diagonals, by turns upwards and downwards."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.asarray([8 * r + c for r, c in cells])


# Bits


def unstuffed(data: bytes) -> bytes:
    return data.replace(b"\xff\x00", b"\xff")


def padded(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled with ones, with a zero byte after each FF."""
    bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def binary(values: np.ndarray, width: int) -> np.ndarray:
    """Values below 2 ** 16 as rows of `width` bits, the highest first."""
    return np.unpackbits(values.astype(">u2")[..., None].view(np.uint8), axis=-1)[..., 16 - width :]


def number(bits: np.ndarray) -> np.ndarray:
    """The numbers of at most 16 bits that `binary` wrote."""
    room = np.zeros((*bits.shape[:-1], 16), np.uint8)
    room[..., 16 - bits.shape[-1] :] = bits
    return np.packbits(room, axis=-1).view(">u2")[..., 0].astype(np.int32)


# Writing


def segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def one_code(kind: int, slot: int, symbol: int) -> bytes:
    """A table with one symbol, whose code is a zero bit."""
    return segment(0xC4, bytes((16 * kind + slot, 1, *[0] * 15, symbol)))


def scan(components: list[int], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return segment(0xDA, bytes((len(components), *(x for c in components for x in (c, 0)), first, last, 16 * high + low))) + data


def restarted(rows: np.ndarray) -> bytes:
    """Rows of bits, each padded to bytes and followed by the next restart marker but for the last."""
    parts = np.packbits(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)), constant_values=1), axis=1)
    out = [p.tobytes().replace(b"\xff", b"\xff\x00") for p in parts]
    return b"".join(x for k, p in enumerate(out) for x in (p, bytes((0xFF, 0xD0 + k % 8)))) [:-2]


def end_runs(values: np.ndarray) -> bytes:
    """The last refinement scan where every coefficient is known: runs of blocks of one category, each followed by a bit for each coefficient."""
    parts = []
    for at in range(0, len(values), 32767):
        some = values[at : at + 32767]
        width = len(some).bit_length() - 1
        parts += [np.zeros(1, np.uint8), binary(np.asarray(len(some) - (1 << width)), width), (some & 1).astype(np.uint8).ravel()]
    return padded(np.concatenate(parts))


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose quantised coefficients, less SHIFT, are the payload, of a positive multiple of 192 bytes."""
    n = len(payload) // UNIT
    rows = -(-n // WIDEST)
    across = -(-n // rows)
    values = np.full((rows * across, 3, 64), SHIFT, np.int32)
    values[:n] += np.frombuffer(payload, np.uint8).reshape(n, 3, 64)
    blocks = rows * across
    out = [b"\xff\xd8", segment(0xFE, TAG + len(payload).to_bytes(8, "big")), segment(0xDB, bytes((0, *[1] * 64)))]
    out.append(segment(0xC2, bytes((8, *(8 * rows).to_bytes(2, "big"), *(8 * across).to_bytes(2, "big"), 3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0))))
    # DC: seven bits and a sign for each, predicted from 0 in each unit by a restart, then the lowest bit
    out += [one_code(0, 0, 8), segment(0xDD, b"\0\1")]
    dc = binary(values[:, :, 0] >> 1, 9).reshape(blocks, 27)
    out += [scan([1, 2, 3], 0, 0, 0, 1, restarted(dc)), segment(0xDD, b"\0\0")]
    out.append(scan([1, 2, 3], 0, 0, 1, 0, padded((values[:, :, 0] & 1).astype(np.uint8).ravel())))
    # AC: the upper bits, the first component's in two bands, then the lowest bit
    out.append(one_code(1, 0, 8))
    for c, first, last in ((0, 1, 5), (0, 6, 63), (1, 1, 63), (2, 1, 63)):
        high = values[:, c, first : last + 1]
        out.append(scan([c + 1], first, last, 0, 1, padded(binary(high >> 1, 9).ravel())))  # the code and the 8 bits
    chunks = {min(32767, blocks - at) for at in range(0, blocks, 32767)}
    symbols = sorted({16 * (x.bit_length() - 1) for x in chunks})
    plain = len(symbols) == 1
    if plain:
        out.append(one_code(1, 0, symbols[0]))
        out += [scan([c + 1], 1, 63, 1, 0, end_runs(values[:, c, 1:])) for c in range(3)]
    else:  # runs of two categories: a scan cannot be cut, so that every block gets a run of its own
        out.append(one_code(1, 0, 0))
        for c in range(3):
            bits = np.zeros((blocks, 64), np.uint8)
            bits[:, 1:] = values[:, c, 1:] & 1
            out.append(scan([c + 1], 1, 63, 1, 0, padded(bits.ravel())))
    return b"".join([*out, b"\xff\xd9"])


# Reading


class Codes:
    """A Huffman table: `one` holds its symbol if there is but one, of the code 0."""

    def __init__(self, lengths: bytes, symbols: bytes) -> None:
        self.found, code, k = {}, 0, 0
        for size, many in enumerate(lengths, 1):
            for _ in range(many):
                self.found[size, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.one = symbols[0] if len(symbols) == 1 and lengths[0] == 1 else None


class Bits:
    def __init__(self, data: bytes) -> None:
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n].tolist():
            value = 2 * value + b
        self.at += n
        return value

    def symbol(self, codes: Codes) -> int:
        code = 0
        for size in range(1, 17):
            code = 2 * code + self.take(1)
            if (size, code) in codes.found:
                return codes.found[size, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


class Image:
    """The state of a file while its scans come in: one array of coefficients (rows, columns, 64) for each component."""

    def __init__(self) -> None:
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], Codes] = {}
        self.parts: dict[int, dict] = {}
        self.order: list[int] = []
        self.restart, self.height, self.width, self.comment = 0, 0, 0, b""

    def frame(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        for k in range(body[5]):
            name, factor, table = body[6 + 3 * k : 9 + 3 * k]
            self.parts[name] = {"h": factor >> 4, "v": factor & 15, "q": table}
            self.order.append(name)
        self.hmax, self.vmax = max(p["h"] for p in self.parts.values()), max(p["v"] for p in self.parts.values())
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for p in self.parts.values():
            p["wide"], p["high"] = -(-(-(-self.width * p["h"] // self.hmax)) // 8), -(-(-(-self.height * p["v"] // self.vmax)) // 8)
            p["coef"] = np.zeros((self.down * p["v"], self.across * p["h"], 64), np.int32)

    def scan(self, body: bytes, data: bytes) -> None:
        names = [body[1 + 2 * k] for k in range(body[0])]
        slots = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
        first, last, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
        high, low = approx >> 4, approx & 15
        units = restart_parts(data) if self.restart else [unstuffed(data)]
        if _even(self, names, slots, first, last, high, low, units):
            return
        pieces = self.units(names)
        for k, part in enumerate(units):
            some = pieces[k * self.restart : (k + 1) * self.restart] if self.restart else pieces
            _one_by_one(self, Bits(part), some, slots, first, last, high, low)

    def units(self, names: list[int]) -> list[list[tuple[int, int, int]]]:
        """The blocks (component, row, column) of each unit of a scan."""
        if len(names) == 1:
            p = self.parts[names[0]]
            return [[(names[0], r, c)] for r in range(p["high"]) for c in range(p["wide"])]
        inside = [(n, v, h) for n in names for v in range(self.parts[n]["v"]) for h in range(self.parts[n]["h"])]
        return [[(n, r * self.parts[n]["v"] + v, c * self.parts[n]["h"] + h) for n, v, h in inside] for r in range(self.down) for c in range(self.across)]


def restart_parts(data: bytes) -> list[bytes]:
    """The parts between restart markers, without stuffing."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
    edges = [0, *(at + 2).tolist()], [*at.tolist(), len(data)]
    return [unstuffed(data[a:b]) for a, b in zip(*edges, strict=True)]


def _even(image: Image, names: list[int], slots: dict, first: int, last: int, high: int, low: int, units: list[bytes]) -> bool:
    """Reads a scan whose codes all have one width, if it is one; else changes nothing."""
    parts = [image.parts[n] for n in names]
    if any(p["h"] != 1 or p["v"] != 1 for p in image.parts.values()):
        return False
    blocks, many = parts[0]["high"] * parts[0]["wide"], len(names)
    if first == 0 and last == 0:
        if high:  # one bit for each block, in turns of the components
            if image.restart:
                return False
            bits = np.unpackbits(np.frombuffer(units[0], np.uint8))[: blocks * many].reshape(blocks, many)
            for k, p in enumerate(parts):
                p["coef"].reshape(-1, 64)[:, 0] |= bits[:, k].astype(np.int32) << low
            return True
        tables = [image.codes.get((0, slots[n] >> 4)) for n in names]
        size = tables[0].one if tables[0] else None
        if image.restart != 1 or size is None or any(t is None or t.one != size for t in tables) or len(units) != blocks:
            return False
        width = many * (size + 1)
        if {len(u) for u in units} != {-(-width // 8)}:
            return False
        bits = np.unpackbits(np.frombuffer(b"".join(units), np.uint8).reshape(blocks, -1), axis=1)[:, :width].reshape(blocks, many, size + 1)
        if bits[:, :, 0].any() or not size or not bits[:, :, 1].all():
            return False
        for k, p in enumerate(parts):
            p["coef"].reshape(-1, 64)[:, 0] = number(bits[:, k, 1:]) << low
        return True
    codes, coef, band = image.codes.get((1, slots[names[0]] & 15)), parts[0]["coef"].reshape(-1, 64), last - first + 1
    if codes is None or codes.one is None or image.restart or len(coef) != blocks:
        return False
    bits = np.unpackbits(np.frombuffer(units[0], np.uint8))
    if not high:
        size = codes.one
        if not 0 < size < 16 or len(bits) < blocks * band * (size + 1):
            return False
        grid = bits[: blocks * band * (size + 1)].reshape(blocks, band, size + 1)
        if grid[:, :, 0].any() or not grid[:, :, 1].all():
            return False
        coef[:, first : last + 1] = number(grid[:, :, 1:]) << low
        return True
    if codes.one & 15 or codes.one == 0xF0 or not (coef[:, first : last + 1] > 0).all():
        return False
    width, at, done = codes.one >> 4, 0, 0  # runs of blocks, whose coefficients have one bit each
    grid = np.zeros((blocks, band), np.uint8)
    while done < blocks:
        if width == 0:  # each block is its own run
            need = (blocks - done) * (band + 1)
            rows = bits[at : at + need]
            if len(rows) < need or rows.reshape(-1, band + 1)[:, 0].any():
                return False
            grid[done:] = rows.reshape(-1, band + 1)[:, 1:]
            break
        if len(bits) < at + 1 + width or bits[at]:
            return False
        run = (1 << width) + int(number(bits[at + 1 : at + 1 + width]))
        at += 1 + width
        if done + run > blocks or len(bits) < at + run * band:
            return False
        grid[done : done + run] = bits[at : at + run * band].reshape(run, band)
        at, done = at + run * band, done + run
    coef[:, first : last + 1] |= grid.astype(np.int32) << low
    return True


def _one_by_one(image: Image, bits: Bits, units: list, slots: dict, first: int, last: int, high: int, low: int) -> None:
    """The scan's bits as the format has them: one symbol after another."""
    before, run, one = dict.fromkeys(slots, 0), 0, 1 << low

    def refine(coef: np.ndarray, k: int) -> None:
        if bits.take(1) and not (abs(int(coef[k])) & one):
            coef[k] += one if coef[k] > 0 else -one

    for unit in units:
        for name, r, c in unit:
            coef = image.parts[name]["coef"][r, c]
            if first == 0:
                if high:
                    coef[0] |= bits.take(1) << low
                else:
                    before[name] += bits.signed(bits.symbol(image.codes[0, slots[name] >> 4]))
                    coef[0] = before[name] << low
                continue
            codes, k = image.codes[1, slots[name] & 15], first
            if not high:
                if run:
                    run -= 1
                    continue
                while k <= last:
                    symbol = bits.symbol(codes)
                    zeros, size = symbol >> 4, symbol & 15
                    if size:
                        k += zeros
                        coef[k] = bits.signed(size) * one
                        k += 1
                    elif zeros == 15:
                        k += 16
                    else:
                        run = (1 << zeros) - 1 + bits.take(zeros)
                        break
                continue
            if not run:
                while k <= last:
                    symbol = bits.symbol(codes)
                    zeros, size = symbol >> 4, symbol & 15
                    value = 0
                    if size:
                        value = one if bits.take(1) else -one
                    elif zeros < 15:
                        run = (1 << zeros) + bits.take(zeros)
                        break
                    while k <= last:
                        if coef[k]:
                            refine(coef, k)
                        elif zeros == 0:
                            coef[k] = value
                            k += 1
                            break
                        else:
                            zeros -= 1
                        k += 1
            if run:
                for j in range(k, last + 1):
                    if coef[j]:
                        refine(coef, j)
                run -= 1


def coefficients(media: bytes) -> Image:
    """All scans of a progressive JPEG, accumulated. Raises ValueError for anything else."""
    image, at = Image(), 2
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at + 4 <= len(media):
        marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        if media[at] != 0xFF:
            raise ValueError("a marker is missing")
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                many = sum(body[1:17])
                image.codes[body[0] >> 4, body[0] & 15] = Codes(body[1:17], body[17 : 17 + many])
                body = body[17 + many :]
        elif marker == 0xDD:
            image.restart = int.from_bytes(body, "big")
        elif marker == 0xC2:
            image.frame(body)
        elif marker in (0xC0, 0xC1, *range(0xC5, 0xD0), 0xC3):
            raise ValueError("not progressive with Huffman codes")
        elif marker == 0xDA:
            end = at
            while (end := media.find(b"\xff", end)) >= 0 and end + 1 < len(media) and (media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7):
                end += 2
            end = len(media) if end < 0 else end
            image.scan(body, media[at:end])
            at = end
            if media[at : at + 2] == b"\xff\xd9":
                break
    return image


@lru_cache
def transform() -> np.ndarray:
    """The inverse transform of 64 coefficients in zigzag order to 64 samples, times 2 ** 12, in whole numbers: sums are exact in any order."""
    x = np.arange(8)
    basis = np.where(x[:, None] == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16)
    full = np.einsum("ur,vc->uvrc", basis, basis).reshape(64, 64)
    return np.rint(full[zigzag()] * 4096)


def rgb(image: Image) -> np.ndarray:
    """Samples of full resolution, (height, width, 3) of uint8; a single component is grey, and chroma is upsampled by repetition."""
    planes = []
    for name in image.order[:3]:
        p = image.parts[name]
        high, wide, _ = p["coef"].shape
        samples = (p["coef"] * image.quant[p["q"]]).reshape(-1, 64).astype(np.float64) @ transform()
        plane = np.clip(np.floor(samples / 4096 + 128.5), 0, 255).reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * high, 8 * wide)
        plane = plane.repeat(image.vmax // p["v"], 0).repeat(image.hmax // p["h"], 1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) < 3:
        return np.stack(planes[:1] * 3, -1).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def decode(media: bytes) -> np.ndarray:
    return rgb(coefficients(media))


def stored(image: Image) -> bytes:
    """The payload of a file that `encode_payload` wrote."""
    size = int.from_bytes(image.comment[len(TAG) :], "big")
    coef = np.stack([image.parts[n]["coef"].reshape(-1, 64) for n in image.order], 1)
    return (coef - SHIFT).astype(np.uint8).tobytes()[:size]


def payload_of(text: bytes) -> bytes:
    """The bytes and as many of 32 as make a positive multiple of 192."""
    return text + bytes([FILL]) * (UNIT - len(text) if not text else -len(text) % UNIT)


def encoded_parts(payload: bytes) -> Iterator[bytes]:
    """The stored form of a payload: a file for each PART bytes, one after another, so that memory does not grow with the text."""
    for at in range(0, len(payload), PART):
        yield encode_payload(payload[at : at + PART])


def feature(tensors: Iterator[np.ndarray]) -> str:
    """Of a payload's tensors, one below another: height x width : the channels' means in hundredths : shares of 16 levels of brightness in thousandths, all whole numbers."""
    high = wide = n = 0
    sums, levels = np.zeros(3, np.int64), np.zeros(16, np.int64)
    for tensor in tensors:
        flat = tensor.reshape(-1, 3)
        high, wide, n = high + tensor.shape[0], max(wide, tensor.shape[1]), n + len(flat)
        sums += flat.sum(0, dtype=np.int64)
        levels += np.bincount(flat.sum(1, dtype=np.int64) // 48, minlength=16)[:16]
    return f"{high}x{wide}:{','.join(map(str, sums * 100 // n))}:{','.join(map(str, levels * 1000 // n))}"


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, part (from 0), media (the stored form, binary) and tensor (height, width, rgb binary) of every text, a row for each PART bytes of it.

    A null text is empty; repeated rows give equal rows; no rows, no rows. Columns other than doc_id and text are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("media", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])
        for batch in batches:
            for k in range(batch.num_rows):
                for part, media in enumerate(encoded_parts(payload_of((batch.column(1)[k].as_py() or "").encode()))):
                    tensor = decode(media)
                    yield pa.RecordBatch.from_pylist([{"doc_id": batch.column(0)[k].as_py(), "part": part, "media": media, "height": tensor.shape[0], "width": tensor.shape[1], "rgb": tensor.tobytes()}], schema)

    return texts(docs).mapInArrow(each, "doc_id long, part int, media binary, height int, width int, rgb binary")


def digest(text: bytes) -> tuple:
    """The values of FIELDS but the id: each part is stored, read back and taken as a tensor before the next one."""
    back, form, sizes, tail = hashlib.sha256(), hashlib.sha256(), [0, 0], b""

    def tensors() -> Iterator[np.ndarray]:
        nonlocal tail
        for media in encoded_parts(payload_of(text)):
            image = coefficients(media)
            read = stored(image)
            back.update(read)
            form.update(media)
            sizes[0], sizes[1], tail = sizes[0] + len(read), sizes[1] + len(media), read[-16:]
            yield rgb(image)

    found = feature(tensors())
    return len(text), sizes[0], back.hexdigest(), zlib.crc32(tail), sizes[1], form.hexdigest(), found


def digests(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: what was stored, what was read back, and features of the tensor. A null text is empty; repeated rows get equal values; no rows, no rows. Columns other than doc_id and text are not read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = [x.split()[0] for x in FIELDS.split(", ")]
        for batch in batches:
            seen: dict[bytes, tuple] = {}  # of this batch: equal texts are stored once
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py() or b""
                if text not in seen:
                    seen[text] = digest(text)
                rows.append((i, *seen[text]))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return texts(docs).select("doc_id", F.encode("text", "UTF-8").alias("text")).mapInArrow(each, FIELDS)
