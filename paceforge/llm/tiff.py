"""TIFF media columns: one row per page of each image file.

The reader walks the image directories of either byte order, gathers strips or
tiles, undoes PackBits, LZW or deflate and then the predictor, and returns the
samples of the page in row order. The writer makes such files, for tests and to
store byte payloads without loss as 8-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_batches

#: Tag numbers and compression codes of the TIFF 6.0 format (fixed values).
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q"}


#: A page, and a block of it, may hold as many bytes of samples as this; more is an error.
MAX_BYTES = 1 << 28
#: Pages leave a task once so many bytes of them are read.
HELD_BYTES = 16 << 20
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class TiffError(ValueError):
    """The file breaks the format, or uses a part of it that is not read here."""


def unpack_bits(data: bytes, need: int) -> bytes:
    """The first ``need`` bytes, or all there are."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < need:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out[:need])


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        end = i + 1
        while end < len(data) and end - i < 128 and data[end : end + 3] != data[end : end + 1] * 3:
            end += 1
        out += bytes([end - i - 1]) + data[i:end]
        i = end
    return bytes(out)


def lzw_decode(data: bytes, need: int) -> bytes:
    """TIFF's LZW: most significant bit first, 9 to 12 bits, the width grows one code early. The first ``need`` bytes, or all there are."""
    out, table, previous, made = [], [], b"", 0
    width, held, bits = 9, 0, 0
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(base)
    for byte in data:
        if made >= need:
            break
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 256:
            table, width, previous = list(base), 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(entry)
        made += len(entry)
        if previous and len(table) < 4096:
            table.append(previous + entry[:1])
        previous = entry
        width = min(12, (len(table) + 1).bit_length())
        width = max(9, width)
    return b"".join(out)[:need]


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table, width, prefix = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, width)
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix], width)
        table[longer] = len(table) + 2
        size = len(table) + 2
        if size >= 4094:
            put(256, 12)
            table, width = {bytes([k]): k for k in range(256)}, 9
        else:
            width = max(9, size.bit_length())
        prefix = data[i : i + 1]
    if prefix:
        put(table[prefix], width)
        size = len(table) + 3
        width = min(12, max(9, size.bit_length()))
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def inflate(data: bytes, need: int) -> bytes:
    """The first ``need`` bytes of the stream, or all there are."""
    try:
        return zlib.decompressobj().decompress(data, max(1, need))
    except zlib.error as error:
        raise TiffError(f"deflate: {error}") from error


#: Compression: (packed, bytes needed) -> bytes; what a page does not need is not unpacked.
DECODERS = {NONE: lambda x, n: x[:n], LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6), OLD_DEFLATE: lambda x: zlib.compress(x, 6), PACKBITS: pack_bits}


def directories(data: bytes) -> list[tuple[str, dict[int, tuple]]]:
    """(byte order, {tag: values}) of each directory, in the order of the chain; a chain that returns to itself is an error."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise TiffError("no TIFF header")
    out, seen = [], set()
    try:
        (at,) = struct.unpack_from(order + "I", data, 4)
        while at:
            if at in seen:
                raise TiffError("directories form a loop")
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", data, at)
            tags = {}
            for k in range(n):
                entry = at + 2 + 12 * k
                tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
                if kind in TYPES and count:
                    form = f"{order}{count}{TYPES[kind]}"
                    size = struct.calcsize(form)
                    where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
                    if where + size > len(data):
                        raise TiffError("a value lies outside the file")
                    tags[tag] = struct.unpack_from(form, data, where)
            out.append((order, tags))
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except struct.error as error:
        raise TiffError(f"the file ends early: {error}") from error
    return out


def undo_predictor(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: [row, pixel, sample] in the file's byte order; 2 adds up differences, 3 is the floating point byte shuffle."""
    if predictor == 1:
        return block
    if predictor == 2:
        with np.errstate(over="ignore"):
            native = block.astype(block.dtype.newbyteorder("="))
            return np.cumsum(native, axis=1, dtype=native.dtype).astype(block.dtype)
    if predictor == 3:
        rows, pixels, samples = block.shape
        size = block.dtype.itemsize
        raw = np.ascontiguousarray(block).view(np.uint8).reshape(rows, -1, samples)
        raw = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, size, pixels * samples)
        planes = raw if order == ">" else raw[:, ::-1]
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(block.dtype).reshape(rows, pixels, samples)
    raise TiffError(f"predictor {predictor}")


def _unpack_samples(raw: bytes, kind: np.dtype, bits: int, rows: int, pixels: int, samples: int) -> np.ndarray:
    """[row, pixel, sample]; samples of less than a byte lie from the high bits on, and each row begins with a byte."""
    if bits >= 8:
        return np.frombuffer(raw, kind).reshape(rows, pixels, samples)
    each = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : pixels * samples * bits]
    return each.reshape(rows, pixels, samples, bits) @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)


def read_page(data: bytes, order: str, tags: dict[int, tuple]) -> dict:
    """The page's sizes and its samples as bytes, row by row, pixels interleaved, least significant byte first; samples of less than a byte take one each."""

    def one(tag: int, default: int | None = None) -> int | None:
        value = tags.get(tag, (default,))[0]
        if value is not None and not isinstance(value, int):
            raise TiffError(f"tag {tag} is not a whole number")
        return value

    width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if not width or not height or samples < 1 or len(set(tags.get(BITS, (1,)))) > 1:
        raise TiffError("sizes are missing or differ by sample")
    if compression not in DECODERS:
        raise TiffError(f"compression {compression}")
    if bits not in (1, 2, 4, 8, 16, 32, 64) or (bits < 8 and predictor != 1):
        raise TiffError(f"{bits} bits per sample, predictor {predictor}")
    size = max(1, bits // 8)
    if min(width, height) < 0 or width * height * samples * size > MAX_BYTES:
        raise TiffError(f"{width} x {height} x {samples} samples of {bits} bits")
    kind = np.dtype(f"{order}u{size}")
    tiled = TILE_OFFSETS in tags
    across, down = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, ())
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    if not across or not down or min(across, down) < 0 or across * down * depth * size > MAX_BYTES:
        raise TiffError("a block has no size, or too large a one")
    columns, rows = -(-width // across), -(-height // down)
    if len(offsets) != len(counts) or len(offsets) < columns * rows * planes:
        raise TiffError("blocks are missing")
    page = np.zeros((height, width, samples), kind)
    for k in range(columns * rows * planes):
        plane, cell = divmod(k, columns * rows)
        top, left = cell // columns * down, cell % columns * across
        high = down if tiled else min(down, height - top)
        first, size = offsets[k], counts[k]
        if not isinstance(first, int) or not isinstance(size, int) or min(first, size) < 0 or first + size > len(data):
            raise TiffError("a block lies outside the file")
        packed = data[first : first + size]
        need = high * (-(-across * depth * bits // 8))
        raw = DECODERS[compression](packed.translate(_REVERSED) if one(FILL_ORDER, 1) == 2 else packed, need)[:need]
        if len(raw) < need:
            raise TiffError("a block is too short")
        block = undo_predictor(_unpack_samples(raw, kind, bits, high, across, depth), predictor, order)
        part = page[top : top + high, left : left + across, plane : plane + depth]
        part[:] = block[: part.shape[0], : part.shape[1]]
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": compression, "predictor": predictor, "tiled": tiled, "pixels": page.astype(kind.newbyteorder("<")).tobytes()}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 128, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of [height, width, samples] unsigned pages."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4
    for page in pages:
        height, width, samples = page.shape
        kind = page.dtype.newbyteorder(order)
        across, down = tile or (width, min(rows_per_strip, height))
        offsets, counts = [], []
        for top in range(0, height, down):
            for left in range(0, width, across):
                block = page[top : top + down, left : left + across]
                if tile:
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                packed = ENCODERS[compression](block.astype(kind).tobytes())
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed + b"\0" * (len(packed) % 2)
        entries = [(WIDTH, 4, (width,)), (LENGTH, 4, (height,)), (BITS, 3, (8 * kind.itemsize,) * samples), (COMPRESSION, 3, (compression,)), (PHOTOMETRIC, 3, (1 if samples < 3 else 2,)), (SAMPLES, 3, (samples,)), (PLANAR, 3, (1,)), (PREDICTOR, 3, (predictor,))]
        entries += [(TILE_WIDTH, 4, (across,)), (TILE_LENGTH, 4, (down,)), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, (down,)), (STRIP_COUNTS, 4, counts)]
        fields = []
        for tag, form, values in sorted(entries):
            raw = struct.pack(f"{order}{len(values)}{TYPES[form]}", *values)
            if len(raw) > 4:
                fields.append(struct.pack(order + "HHII", tag, form, len(values), len(out)))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                fields.append(struct.pack(order + "HHI", tag, form, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGE = "page int, width long, height long, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def read_pages(files: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = (), describe: Callable[[dict], str] | None = None) -> DataFrame:
    """One row per page: (id, *keep, page, width, height, samples, bits, compression, predictor, tiled, pixels, error).

    Pages count from 0. A null file, a file without a header or with a broken
    directory gives one row with page null and ``error`` set; a page that
    cannot be read, or of more than ``MAX_BYTES`` bytes of samples, gives its
    row with ``error`` and null pixels, and the other pages are still read.
    ``describe`` adds a column ``feature`` of each page that is read. A task
    holds the pages of one batch only up to ``HELD_BYTES`` and one page. Ids
    may be null or repeat; columns other than ``keep`` are not carried.
    """
    names = ("width", "height", "samples", "bits", "compression", "predictor", "tiled", "pixels")
    blank = (None,) * len(names)

    def make():
        def pages(data):
            try:
                found = directories(data or b"")
            except TiffError as error:
                yield (None, *blank, str(error), None)
                return
            for k, (order, tags) in enumerate(found):
                try:
                    page = read_page(data, order, tags)
                    yield (k, *[page[n] for n in names], None, describe(page) if describe else None)
                except (TiffError, ValueError, OverflowError, MemoryError) as error:
                    yield (k, *blank, str(error), None)

        def columns(batch, at, rows):
            kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
            return [*kept, *(list(c) for c in zip(*rows))][: None if describe else -1]

        def run(batch):
            at, rows, held = [], [], 0
            for i, data in enumerate(batch.column(batch.num_columns - 1)):
                for row in pages(data.as_py()):
                    at.append(i)
                    rows.append(row)
                    held += len(row[8] or b"")
                    if held >= HELD_BYTES:
                        yield columns(batch, at, rows)
                        at, rows, held = [], [], 0
            if rows:
                yield columns(batch, at, rows)

        return run

    read = files.select(files[id_col].cast("long").alias(id_col), *[files[c] for c in keep], files[media_col])
    fields = T._parse_datatype_string(PAGE + (", feature string" if describe else "")).fields
    return map_batches(read, T.StructType([*read.schema.fields[:-1], *fields]), make)


def payload_of(text: str | None, multiple: int = 64) -> tuple[bytes, int]:
    """UTF-8 bytes of a text, padded with zero bytes to a positive multiple, and their number before that."""
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(1, -(-len(raw) // multiple)) * multiple, b"\0"), len(raw)


#: By the first byte of a text's SHA-256: codecs in turn (the slow ones seldom), differences or not, strips of some heights or tiles.
CODECS = (LZW, PACKBITS, NONE, OLD_DEFLATE, DEFLATE, DEFLATE, DEFLATE, DEFLATE)
STRIP_ROWS, TILES = (128, 7), (None, None, None, (32, 16))


def layout_of(raw: bytes) -> dict:
    """How a text is stored; equal texts in the same way."""
    a, b = hashlib.sha256(raw).digest()[:2]
    return {"compression": CODECS[a % len(CODECS)], "predictor": 1 + b % 2, "rows_per_strip": STRIP_ROWS[b // 2 % 2], "tile": TILES[b // 4 % 4]}


def store_texts(docs: DataFrame, width: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a one-page TIFF of ``width`` 8-bit samples a row, stored as ``layout_of`` says; null is empty."""

    def make():
        def run(batch):
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                payload, n = payload_of(text, width)
                sizes.append(n)
                media.append(write_tiff([np.frombuffer(payload, np.uint8).reshape(-1, width, 1)], **layout_of(payload[:n])))
            return [batch.column(0), sizes, pa.array(media, pa.binary())]

        return run

    return map_batches(docs.select(docs[id_col].cast("long"), docs[text_col]), f"`{id_col}` long, n_bytes long, media binary", make)


def page_features(page: dict) -> str:
    """Size, value range, sum, and how often a sample differs from its right neighbour."""
    width, height = page["width"], page["height"]
    pixels = np.frombuffer(page["pixels"], np.uint8).reshape(height, width)
    return f"{width}x{height};min={pixels.min()};max={pixels.max()};sum={int(pixels.sum(dtype=np.int64))};edges={int(np.count_nonzero(pixels[:, 1:] != pixels[:, :-1]))}"


def digests(docs: DataFrame) -> DataFrame:
    """Store each text, read it back from the stored bytes alone, and return digests of both and features.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature); the rules are those of ``store_texts`` and
    ``read_pages``.
    """
    stored = store_texts(docs).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = read_pages(stored, keep=("n_bytes", "media_bytes", "media_sha256"), describe=page_features)
    n = F.length("pixels")
    tail = F.substring(F.col("pixels"), n - 63, F.lit(64))
    return pages.select("doc_id", "n_bytes", n.cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
