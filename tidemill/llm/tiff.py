"""TIFF columns: write texts' bytes as images, walk image directories and emit one row per page.

The reader follows the chain of image directories of classic TIFF and BigTIFF in
either byte order, reads strips or tiles, decodes none, PackBits, LZW, deflate
(8 and 32946), undoes predictor 2 (whole numbers of 8, 16 or 32 bits) and 3
(floats), and joins planes. The writer makes rows of 64 pixels of three 8-bit
samples, pages of at most PAGE_ROWS rows in strips of STRIP_ROWS, with deflate
and predictor 2.

Defined results: null and empty texts are one row of blanks; a null or damaged
image gives no pages when damage="skip" and raises ValueError otherwise; a
directory chain that comes back to itself is damage; equal texts give equal bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROW_BYTES, PIXELS, PAGE_ROWS, STRIP_ROWS = 192, 64, 1024, 128
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    parts: int
    pixels: bytes


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c = data[i]
        i += 1
        if c < 128:
            out += data[i : i + c + 1]
            i += c + 1
        elif c > 128:
            out += data[i : i + 1] * (257 - c)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            out += bytes([257 - (j - i), data[i]])
        else:
            j = i + 1
            while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
                j += 1
            out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, widening one code early; 256 clears, 257 ends."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, bits, held, width, last = list(base), bytearray(), 0, 0, 9, None
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            word = table[code]
        else:
            if code < len(table):
                word = table[code]
            elif code == len(table):
                word = last + last[:1]
            else:
                raise ValueError("damaged LZW data")
            table.append(last + word[:1])
        out += word
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table, nxt, width, word = {bytes([i]): i for i in range(256)}, 258, 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held = (held << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256)
    for i in range(len(data)):
        grown = word + data[i : i + 1]
        if grown in table:
            word = grown
            continue
        put(table[word])
        table[grown] = nxt
        nxt += 1
        if nxt == 4094:
            put(256)
            table, nxt, width = {bytes([i]): i for i in range(256)}, 258, 9
        else:
            width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
        word = data[i : i + 1]
    if word:
        put(table[word])
        nxt += 1
        width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def _inflate(data: bytes, code: int) -> bytes:
    if code == NONE:
        return data
    if code in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if code == LZW:
        return unpack_lzw(data)
    if code == PACKBITS:
        return unpack_bits(data)
    raise ValueError(f"compression {code} isn't read")


def _deflate(data: bytes, code: int) -> bytes:
    return {NONE: lambda: data, DEFLATE: lambda: zlib.compress(data, 1), LZW: lambda: pack_lzw(data), PACKBITS: lambda: pack_bits(data)}[code]()


def _undo(raw: np.ndarray, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """Bytes of rows, in the machine-independent order of the file, after the predictor is undone."""
    if predictor == 1:
        return raw.reshape(rows, -1)
    if predictor == 2:
        kind = np.dtype(f"{order}u{bits // 8}")
        x = raw.view(kind).reshape(rows, width, samples)
        return np.cumsum(x, axis=1, dtype=kind.newbyteorder("=")).astype(kind).reshape(rows, -1).view(np.uint8)
    if predictor == 3:
        size = bits // 8
        x = np.cumsum(raw.reshape(rows, width * size, samples) if samples == 1 else raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
        x = x.transpose(0, 2, 1)
        return np.ascontiguousarray(x if order == ">" else x[:, :, ::-1]).reshape(rows, -1)
    raise ValueError(f"predictor {predictor} isn't read")


def walk(data: bytes) -> Iterator[Page]:
    """Every page, by the chain of image directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("no TIFF")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise ValueError("no TIFF")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    seen: set[int] = set()
    number = 0
    try:
        while at:
            if at in seen:
                raise ValueError("directories form a ring")
            seen.add(at)
            n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
            step, head, room = (20, 8, 8) if big else (12, 2, 4)
            tags: dict[int, tuple] = {}
            for k in range(n):
                p = at + head + k * step
                tag, kind = struct.unpack_from(order + "HH", data, p)
                count = struct.unpack_from(order + ("Q" if big else "I"), data, p + 4)[0]
                size, where = _SIZES.get(kind, 1) * count, p + (12 if big else 8)
                if size > room:
                    where = struct.unpack_from(order + ("Q" if big else "I"), data, where)[0]
                if kind in _CODES and kind != 2:
                    tags[tag] = struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, where)
            yield _page(data, tags, number, order)
            number += 1
            at = struct.unpack_from(order + ("Q" if big else "I"), data, at + head + n * step)[0]
    except (struct.error, zlib.error, KeyError, IndexError) as e:
        raise ValueError(f"damaged TIFF: {e}") from e


def _page(data: bytes, tags: dict[int, tuple], number: int, order: str) -> Page:
    one = lambda t, d: tags.get(t, (d,))[0]
    width, height, samples, bits = tags[256][0], tags[257][0], one(277, 1), one(258, 1)
    code, predictor, planar = one(259, 1), one(317, 1), one(284, 1)
    per, planes = (samples, 1) if planar == 1 else (1, samples)
    tiled = 322 in tags
    tw, th = (tags[322][0], tags[323][0]) if tiled else (width, min(one(278, height), height))
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    row_bytes = (tw * per * bits + 7) // 8
    across, down = -(-width // tw), -(-height // th) if height else 0
    full = []
    for plane in range(planes):
        lines = []
        for y in range(down):
            rows = th if tiled else min(th, height - y * th)
            cells = []
            for x in range(across):
                k = plane * across * down + y * across + x
                raw = np.frombuffer(_inflate(data[offsets[k] : offsets[k] + counts[k]], code), np.uint8)[: rows * row_bytes]
                if raw.size < rows * row_bytes:
                    raise ValueError("a strip or tile is too short")
                cells.append(_undo(raw, rows, tw, per, bits, predictor, order))
            lines.append(cells[0] if across == 1 else np.concatenate(cells, axis=1))
        image = (np.concatenate(lines) if lines else np.zeros((0, row_bytes), np.uint8))[:height]
        full.append(image[:, : (width * per * bits + 7) // 8])
    if planes > 1:
        size = max(1, bits // 8)
        full = [np.stack([p.reshape(height, width, size) for p in full], axis=2).reshape(height, -1)]
    return Page(number, width, height, samples, bits, code, predictor, tiled, len(offsets), full[0].tobytes())


def write(payload: bytes, compression: int = DEFLATE, predictor: int = 2, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS) -> bytes:
    """The payload, of a positive multiple of 192 bytes, as a little-endian TIFF of one or more pages."""
    if not payload or len(payload) % ROW_BYTES:
        raise ValueError("the payload isn't a positive multiple of 192 bytes")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, PIXELS, 3)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(rows), page_rows):
        image = rows[top : top + page_rows]
        offsets, counts = [], []
        for y in range(0, len(image), strip_rows):
            part = image[y : y + strip_rows]
            if predictor == 2:
                part = part.copy()
                part[:, 1:] -= image[y : y + strip_rows, :-1]
            packed = _deflate(part.tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        out += b"\0" * (len(out) % 2)

        def place(values: list[int]) -> int:
            if len(values) == 1:
                return values[0]
            at = len(out)
            out.extend(struct.pack(f"<{len(values)}I", *values))
            return at

        bits_at = len(out)
        out += struct.pack("<4H", 8, 8, 8, 0)
        tags = [(256, 4, 1, PIXELS), (257, 4, 1, len(image)), (258, 3, 3, bits_at), (259, 3, 1, compression), (262, 3, 1, 2), (273, 4, len(offsets), place(offsets)), (277, 3, 1, 3), (278, 4, 1, strip_rows), (279, 4, len(counts), place(counts)), (317, 3, 1, predictor)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The number of bytes before padding, and the text's bytes padded with blanks to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % ROW_BYTES if raw else ROW_BYTES)


def feature(pages: list[Page]) -> str:
    """Pages, rows, and mean and standard deviation of each sample in thousandths, from whole-number sums."""
    x = np.concatenate([np.frombuffer(p.pixels, np.uint8) for p in pages]).reshape(-1, 3)
    n, sums, squares = len(x), x.sum(0, dtype=np.int64), (x.astype(np.int64) ** 2).sum(0)
    parts = [f"{int(s) * 1000 // n}:{round((max(0, int(q) * n - int(s) ** 2)) ** 0.5 * 1000 / n)}" for s, q in zip(sums, squares)]
    return f"pages={len(pages)};rows={sum(p.height for p in pages)};rgb={','.join(parts)}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media binary."""

    def make():
        def one(i, t):
            n, payload = payload_of(t)
            return i, n, write(payload)

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_rows(common.texts(docs, id_col, text_col), make, f"doc_id {kind}, n_bytes long, media binary")


def pages(images: DataFrame, id_col: str = "doc_id", media_col: str = "media", damage: str = "raise") -> DataFrame:
    """One row per page: doc_id, page, width, height, samples, bits, compression, predictor, tiled, parts, pixels."""
    kind = images.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = list(walk(data)) if data is not None else []
                except ValueError:
                    if damage != "skip":
                        raise
                    continue
                for p in found:
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i], batch.schema.field(0).type), "page": pa.array([p.number], pa.int32()), "width": pa.array([p.width], pa.int32()), "height": pa.array([p.height], pa.int32()), "samples": pa.array([p.samples], pa.int32()), "bits": pa.array([p.bits], pa.int32()), "compression": pa.array([p.compression], pa.int32()), "predictor": pa.array([p.predictor], pa.int32()), "tiled": pa.array([p.tiled]), "parts": pa.array([p.parts], pa.int32()), "pixels": pa.array([p.pixels], pa.binary())})

    chosen = images.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{media_col}`").alias("media"))
    return common.map_batches(chosen, run, f"doc_id {kind}, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, parts int, pixels binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read the stored bytes back page by page, and return digests: one row a document."""

    def make():
        def one(i, t):
            n, payload = payload_of(t)
            media = write(payload)
            found = list(walk(media))
            back = b"".join(p.pixels for p in found)
            return i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(found), len(found)

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_rows(common.texts(docs, id_col, text_col), make, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int")
