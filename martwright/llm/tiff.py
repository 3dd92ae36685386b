"""Media columns: TIFF files read into one row per page, and bytes stored as TIFF.

The reader walks the chain of image directories (either byte order), decodes strips or tiles stored plainly or by
PackBits, LZW or deflate, undoes the horizontal predictor, and gives each page's samples in row order.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, without

# Fixed values of the TIFF 6.0 format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_BYTES = 284, 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: "B", 3: "H", 4: "I"}  # BYTE, SHORT, LONG
CLEAR, END = 256, 257

ROW = 64  # samples in a row of stored bytes
PAGE_ROWS, STRIP_ROWS, TILE = 1024, 256, 32
MOST_PIXELS = 1 << 30  # bytes that one page may decode to
MOST_HELD = 1 << 25  # bytes of pages that go out at a time, or one page
#: How stored bytes are laid out, in turn by page: (compression, predictor, tiled).
LAYOUTS = ((PACKBITS, 1, False), (LZW, 2, False), (DEFLATE, 2, False), (DEFLATE, 1, True))
_RUN = re.compile(rb"(.)\1{2,127}", re.S)


class BadTiff(ValueError):
    pass


def pack(raw: bytes) -> bytes:
    """PackBits of one row."""
    out, at = bytearray(), 0
    for run in _RUN.finditer(raw):
        for k in range(at, run.start(), 128):
            part = raw[k : min(k + 128, run.start())]
            out.append(len(part) - 1)
            out += part
        out.append(257 - len(run[0]))
        out += run[1]
        at = run.end()
    for k in range(at, len(raw), 128):
        part = raw[k : k + 128]
        out.append(len(part) - 1)
        out += part
    return bytes(out)


def unpack(raw: bytes, size: int) -> bytes:
    out, k = bytearray(), 0
    while k < len(raw) and len(out) < size:
        n = raw[k]
        if n < 128:
            out += raw[k + 1 : k + 2 + n]
            k += n + 2
        else:
            if n > 128:
                out += raw[k + 1 : k + 2] * (257 - n)
                k += 1
            k += 1
    return bytes(out[:size])


def lzw_pack(raw: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, highest bit first; the width grows one code early, as the format asks."""
    out, acc, bits, width = bytearray(), CLEAR, 9, 9
    table: dict[int, int] = {}
    code, free = -1, 258
    for byte in raw:
        if code < 0:
            code = byte
            continue
        key = code << 8 | byte
        known = table.get(key)
        if known is not None:
            code = known
            continue
        acc, bits = acc << width | code, bits + width
        table[key] = free
        free += 1
        code = byte
        if free == 4095:
            acc, bits = acc << width | CLEAR, bits + width
            table.clear()
            free, width = 258, 9
        elif free == 512 or free == 1024 or free == 2048:
            width += 1
        if bits >= 512:
            rest = bits & 7
            out += (acc >> rest).to_bytes(bits >> 3, "big")
            acc, bits = acc & (1 << rest) - 1, rest
    if code >= 0:
        acc, bits = acc << width | code, bits + width
        free += 1
        if free == 512 or free == 1024 or free == 2048:
            width += 1
    acc, bits = acc << width | END, bits + width
    pad = -bits % 8
    return bytes(out + (acc << pad).to_bytes((bits + pad) >> 3, "big"))


def lzw_unpack(raw: bytes, size: int) -> bytes:
    base = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, width, before, held = base[:], [], 9, b"", 0
    acc = bits = 0
    for byte in raw:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == CLEAR:
            table, width, before = base[:], 9, b""
            continue
        if code == END:
            break
        n = len(table)
        if not before:
            if code >= 256:
                raise BadTiff("LZW data begin with no byte")
            word = table[code]
        else:
            if code < n:
                word = table[code]
            elif code == n:
                word = before + before[:1]
            else:
                raise BadTiff("LZW data use a code that isn't there")
            table.append(before + word[:1])
            n += 1
        if n == 511 or n == 1023 or n == 2047:
            width += 1
        out.append(word)
        held += len(word)
        if held >= size:
            break
        before = word
    return b"".join(out)[:size]


def inflate(raw: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(raw, size)
    except zlib.error as e:
        raise BadTiff(f"deflate: {e}") from e


DECODE = {PLAIN: lambda raw, size: raw[:size], PACKBITS: unpack, LZW: lzw_unpack, DEFLATE: inflate, OLD_DEFLATE: inflate}


def directories(raw: bytes) -> Iterator[tuple[str, dict[int, tuple[int, ...]]]]:
    """(byte order, fields) of each image directory in the order of their chain, which may not come back on itself."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(raw[:2]))
    if not order or len(raw) < 8 or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise BadTiff("no TIFF header")
    at, seen = struct.unpack_from(order + "I", raw, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(raw):
            raise BadTiff("the chain of directories is broken")
        seen.add(at)
        n = struct.unpack_from(order + "H", raw, at)[0]
        if at + 6 + 12 * n > len(raw):
            raise BadTiff("a directory goes beyond the file")
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
            if kind not in FIELD:
                continue
            size = struct.calcsize(FIELD[kind]) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * k)[0]
            if place + size > len(raw):
                raise BadTiff("a field goes beyond the file")
            fields[tag] = struct.unpack_from(f"{order}{count}{FIELD[kind]}", raw, place)
        yield order, fields
        at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]


def undo_predictor(rows: np.ndarray, order: str, bits: int) -> np.ndarray:
    """rows: (height, width, bytes of a pixel); each sample is the difference to that of the pixel on its left."""
    if bits == 8:
        return np.cumsum(rows, axis=1, dtype=np.uint8)
    if bits not in (16, 32):
        raise BadTiff(f"a predictor with {bits} bits a sample")
    kind = np.dtype(f"{order}u{bits // 8}")
    return np.cumsum(np.ascontiguousarray(rows).view(kind), axis=1, dtype=kind.newbyteorder("=")).astype(kind).view(np.uint8)


def decode_page(raw: bytes, order: str, f: dict[int, tuple[int, ...]]) -> dict:
    """One page: its sizes and layout, and pixels: its samples in row order, in the file's byte order."""
    try:
        width, height = f[WIDTH][0], f[LENGTH][0]
    except (KeyError, IndexError):
        raise BadTiff("a page without sizes") from None
    samples, planar = f.get(SAMPLES, (1,))[0], f.get(PLANAR, (1,))[0]
    depths = f.get(BITS, (1,))
    bits, compression, predictor = depths[0], f.get(COMPRESSION, (PLAIN,))[0], f.get(PREDICTOR, (1,))[0]
    if compression not in DECODE or predictor not in (1, 2) or len(set(depths)) > 1 or planar not in (1, 2):
        raise BadTiff(f"compression {compression}, predictor {predictor}, bits {depths}, planes {planar}")
    planes = samples if planar == 2 else 1
    pixel_bits = bits * (samples // planes)
    whole = bits % 8 == 0
    tiled = TILE_AT in f
    at, sizes = (f.get(TILE_AT), f.get(TILE_BYTES)) if tiled else (f.get(STRIP_AT), f.get(STRIP_BYTES))
    if not at or not sizes or len(at) != len(sizes):
        raise BadTiff("strips or tiles without places or sizes")
    across, down = (f[TILE_WIDTH][0], f[TILE_LENGTH][0]) if tiled else (width, min(f.get(ROWS_PER_STRIP, (height,))[0], height) or 1)
    line = (across * pixel_bits + 7) // 8
    if not across or not down or not width or not height or line * height * planes > MOST_PIXELS or (tiled and not whole):
        raise BadTiff(f"sizes {width} x {height}, tiles {across} x {down}, {bits} bits")
    columns, rows = -(-width // across), -(-height // down)
    if len(at) < columns * rows * planes:
        raise BadTiff("too few strips or tiles")
    full = (width * pixel_bits + 7) // 8
    page = np.zeros((planes, height, full), np.uint8)
    for k in range(columns * rows * planes):
        plane, row, column = k // (columns * rows), k // columns % rows, k % columns
        tall = down if tiled else min(down, height - row * down)
        if at[k] + sizes[k] > len(raw):
            raise BadTiff("a strip or tile goes beyond the file")
        data = DECODE[compression](raw[at[k] : at[k] + sizes[k]], line * tall)
        if len(data) < line * tall:
            raise BadTiff("a strip or tile is too short")
        block = np.frombuffer(data, np.uint8).reshape(tall, line)
        if predictor == 2:
            if not whole:
                raise BadTiff(f"a predictor with {bits} bits a sample")
            block = undo_predictor(block.reshape(tall, across, pixel_bits // 8), order, bits).reshape(tall, line)
        x = column * line
        part = page[plane, row * down : row * down + tall, x : x + line]
        part[:] = block[: part.shape[0], : part.shape[1]]
    return {"width": width, "height": height, "bits": bits, "samples": samples, "compression": compression, "predictor": predictor, "tiled": tiled, "pixels": page.tobytes()}


def read_pages(raw: bytes | None) -> Iterator[dict]:
    """The pages of a file. A page that can't be read, or the rest of a chain, is one page with an error."""
    if raw is None:
        return
    n = 0
    try:
        for order, fields in directories(raw):
            try:
                yield decode_page(raw, order, fields) | {"page": n}
            except BadTiff as e:
                yield {"page": n, "error": str(e)}
            n += 1
    except BadTiff as e:
        yield {"page": n, "error": str(e)}


def store(payload: bytes) -> bytes:
    """A TIFF of payload, whose length is a positive multiple of 64, as 8-bit samples in rows of 64.

    Pages have up to 1,024 rows. Byte order and each page's layout follow from the payload alone.
    """
    if not payload or len(payload) % ROW:
        raise ValueError("the payload's length must be a positive multiple of 64")
    mark = zlib.crc32(payload)
    order = "<>"[mark >> 8 & 1]
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4  # where the place of the next directory goes
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    for n, top in enumerate(range(0, len(pixels), PAGE_ROWS)):
        page = pixels[top : top + PAGE_ROWS]
        compression, predictor, tiled = LAYOUTS[(mark + n) % len(LAYOUTS)]
        parts = []
        if tiled:
            tall = -(-len(page) // TILE) * TILE
            grid = np.zeros((tall, ROW), np.uint8)
            grid[: len(page)] = page
            parts = [grid[y : y + TILE, x : x + TILE] for y in range(0, tall, TILE) for x in range(0, ROW, TILE)]
        else:
            parts = [page[y : y + STRIP_ROWS] for y in range(0, len(page), STRIP_ROWS)]
        places, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            if compression == PACKBITS:
                data = b"".join(pack(row.tobytes()) for row in part)
            else:
                data = lzw_pack(part.tobytes()) if compression == LZW else zlib.compress(part.tobytes(), 1)
            places.append(len(out))
            sizes.append(len(data))
            out += data
        fields = [(WIDTH, 3, [ROW]), (LENGTH, 4, [len(page)]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 3, [TILE]), (TILE_LENGTH, 3, [TILE]), (TILE_AT, 4, places), (TILE_BYTES, 4, sizes)] if tiled else [(STRIP_AT, 4, places), (ROWS_PER_STRIP, 4, [STRIP_ROWS]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(fields):
            data = struct.pack(f"{order}{len(values)}{FIELD[kind]}", *values)
            if len(data) > 4:
                place, out = len(out), out + data
                data = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        if len(out) % 2:
            out += b"\0"
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGE = "page int, width int, height int, bits int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"
PAGE_ARROW = {"page": pa.int32(), "width": pa.int32(), "height": pa.int32(), "bits": pa.int32(), "samples": pa.int32(), "compression": pa.int32(), "predictor": pa.int32(), "tiled": pa.bool_(), "pixels": pa.binary(), "error": pa.string()}


def pages(df: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page of the TIFF in media_col: df's other columns, then PAGE's.

    Pages come in file order, next to each other. A file that is no TIFF, is cut short or uses a layout that isn't read
    gives a row with an error and null pixels at the page where reading ended; a null file gives no row. Repeated rows
    each give their pages. An empty table gives an empty result. Other columns named like PAGE's are replaced.
    """
    others = without(df.columns, media_col, *PAGE_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.RecordBatch, row: list[int], found: list[dict]) -> pa.RecordBatch:
            keep = pa.array(row, pa.int64())
            arrays = [batch.column(i).take(keep) for i in range(len(others))]
            arrays += [pa.array([p.get(name) for p in found], kind) for name, kind in PAGE_ARROW.items()]
            return pa.RecordBatch.from_arrays(arrays, [*others, *PAGE_ARROW])

        for batch in slices(batches, 32, len(others)):
            row, found, held = [], [], 0
            for k, raw in enumerate(batch.column(len(others))):
                for page in read_pages(raw.as_py()):
                    row.append(k)
                    found.append(page)
                    held += len(page.get("pixels") or b"")
                    if held >= MOST_HELD:
                        yield out(batch, row, found)
                        row, found, held = [], [], 0
            if row:
                yield out(batch, row, found)

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others), PAGE])
    return df.select(*others, media_col).mapInArrow(run, schema)


def stored(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' other columns, n_bytes and media: each whole text as UTF-8, zero-filled to a positive multiple of 64, as TIFF.

    A null text is empty. Repeated rows each keep their row. An empty table gives an empty result. Other columns named
    n_bytes or media are replaced.
    """
    others = without(docs.columns, text_col, "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128, len(others)):
            texts = [t or b"" for t in batch.column(len(others)).cast(pa.large_binary()).to_pylist()]
            media = [store(t + b"\0" * (-len(t) % ROW or (0 if t else ROW))) for t in texts]
            arrays = [batch.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], [*others, "n_bytes", "media"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "n_bytes long, media binary"])
    return docs.select(*others, F.col(text_col).cast("string")).mapInArrow(run, schema)


def feature(payload: bytes, codecs: str) -> str:
    """Pages' codecs, mean and deviation of the samples, and the shares of their eight ranges in thousandths."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    return f"{codecs} mean={x.mean():.3f} std={x.std():.3f} ranges={','.join(map(str, shares))}"


def payloads(paged: DataFrame) -> DataFrame:
    """Pages of stored(), next to each other as pages() gives them, folded to a row for each file: its payload's digests."""
    names = {COMPRESSION: {PACKBITS: "packbits", LZW: "lzw", DEFLATE: "deflate", PLAIN: "plain"}}[COMPRESSION]

    def fold(rows: list[dict]) -> dict:
        if bad := next((r["error"] for r in rows if r["error"]), None):
            raise BadTiff(f"a stored text can't be read back: {bad}")
        payload = b"".join(r["pixels"] for r in rows)
        codecs = "+".join(f"{name}*{sum(1 for _ in same)}" for name, same in groupby(names[r["compression"]] + ("/tiles" if r["tiled"] else "") for r in rows))
        first = {k: rows[0][k] for k in ("doc_id", "n_bytes", "media_bytes", "media_sha256")}
        return first | {"payload_bytes": len(payload), "payload_sha256": sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "feature": feature(payload, codecs)}

    out = "doc_id %s, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    columns = [c.split()[0] for c in out.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[dict] = []
        kind = None
        for batch in batches:
            kind, done = batch.column(0).type, []
            for row in (r for part in slices([batch], 64) for r in part.to_pylist()):
                if row["page"] == 0 and open_rows:
                    done.append(fold(open_rows))
                    open_rows = []
                open_rows.append(row)
            yield batch_of(done, kind)
        if open_rows:
            yield batch_of([fold(open_rows)], kind)

    def batch_of(done: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], t) for c, t in zip(columns, [kind, *kinds], strict=True)], columns)

    need = ["doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "compression", "tiled", "pixels", "error"]
    return paged.select(*need).mapInArrow(run, out % paged.schema["doc_id"].dataType.simpleString())


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each whole text stored as TIFF and read back, one row for each row of docs; a null text is empty."""
    media = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    media = media.withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    return payloads(pages(media))
