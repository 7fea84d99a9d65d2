"""TIFF media columns: a reader that emits one row per page, and a writer for lossless 8-bit payloads.

The reader walks the chain of image directories (either byte order), decodes PackBits, LZW, deflate or plain strips
and tiles, together or in planes, undoes horizontal differencing of whole numbers of 8 to 64 bits and the byte-wise
differencing of floating-point ones, and gives each page's samples row by row: little-endian, samples of fewer than 8 bits as a byte
each. A page that cannot be decoded is a row with its error and null samples; the pages before it stay.
So is one whose sizes are zero, do not fit its stored bytes, or come to more than MOST bytes of samples. Null and empty
media give no rows, repeated rows give theirs again, and an empty table gives none. Rows leave in batches of bounded
bytes, a file at a time; a page is held whole.

The writer lays a payload out as grey pages, WIDTH samples wide. Which codec a payload gets depends on its CRC alone,
so equal payloads give equal files and a corpus passes through every decoder. What is read back comes as the same page
rows. A null text counts as empty, a very long one has many pages.
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

from .common import column, slices

WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 576, 128, 16, (192, 64)
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Codec, horizontal differencing, tiles, by the remainder of the payload's CRC.
LAYOUTS = ((PACKBITS, False, False), (LZW, False, False), (DEFLATE, True, True), (DEFLATE, True, False))
#: Format constants: directory tags and the sizes of the field types that the reader takes.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "strip_rows": 278, "strip_counts": 279, "planar": 284, "predictor": 317, "fill_order": 266, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325, "sample_format": 339}
TYPES = {1: "B", 3: "H", 4: "I"}
CLEAR, STOP, WIDEST = 256, 257, 4094
#: Predictors, and the sample format of floating-point numbers.
HORIZONTAL, FLOATING, REAL = 2, 3, 3
#: Every byte with its bits the other way round.
TURNED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1]).tobytes()
#: Bytes of samples that one page may have: a column's value is held whole.
MOST = 1 << 30
#: Bytes that a stored byte becomes, at most, by codec.
GROWS = {PLAIN: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}
#: Bytes of the pages that leave in one batch, about.
BATCH_BYTES = 4 << 20


@dataclass
class Page:
    number: int
    width: int = 0
    height: int = 0
    samples: int = 0
    bits: int = 0
    compression: int = 0
    predictor: int = 0
    tiled: bool = False
    data: np.ndarray | None = None  # [row, bytes]
    error: str | None = None


def lzw_widths(count: int) -> np.ndarray:
    """Bits of each code after a clear code; a width grows one code before its numbers run out."""
    entries = 257 + np.arange(count)
    return 9 + (entries >= 511).astype(np.int64) + (entries >= 1023) + (entries >= 2047)


WIDTHS = lzw_widths(WIDEST)
PLACES = np.cumsum(WIDTHS) - WIDTHS


def lzw_decode(data: bytes) -> bytes:
    wide = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64)
    bit, end, out = 0, len(data) * 8, []
    while bit < end:
        # all codes up to the next clear code stand at places known beforehand
        places = bit + PLACES
        places = places[places + WIDTHS[: len(places)] <= end]
        byte = places >> 3
        word = wide[byte] << 16 | wide[byte + 1] << 8 | wide[byte + 2]
        size = WIDTHS[: len(places)]
        codes = word >> (24 - (places & 7) - size) & (1 << size) - 1
        halt = np.flatnonzero((codes == CLEAR) | (codes == STOP))
        upto = int(halt[0]) if len(halt) else len(codes)
        if upto:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            grow, keep = table.append, out.append
            listed = codes[:upto].tolist()
            last = table[listed[0]]
            keep(last)
            for code in listed[1:]:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise ValueError("LZW code out of order")
                keep(entry)
                grow(last + entry[:1])
                last = entry
        if not len(halt) or codes[upto] == STOP:
            break
        bit = int(places[upto] + size[upto])
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, widths = [np.array([CLEAR])], [np.array([9])]
    first = {bytes((i,)): i for i in range(256)}
    at = 0
    while True:
        table, found = dict(first), []
        code, size = 258, len(data)
        word = b""
        while at < size:
            longer = word + data[at : at + 1]
            if longer in table:
                word = longer
            else:
                found.append(table[word])
                if code == WIDEST - 1:
                    word = b""
                    break
                table[longer] = code
                code += 1
                word = longer[-1:]
            at += 1
        else:
            found += [table[word]] if word else []
            found.append(STOP)
            codes.append(np.array(found))
            widths.append(WIDTHS[: len(found)])
            break
        found.append(CLEAR)
        codes.append(np.array(found))
        widths.append(WIDTHS[: len(found)])
    every, size = np.concatenate(codes), np.concatenate(widths)
    bits = (every[:, None] >> np.arange(11, -1, -1) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) >= 12 - size[:, None]]).tobytes()


def packbits_decode(data: bytes) -> bytes:
    out, at, size = [], 0, len(data)
    while at < size:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += head + 2
        else:
            if head > 128:
                out.append(data[at + 1 : at + 2] * (257 - head))
                at += 1
            at += 1
    return b"".join(out)


def packbits_encode(row: bytes) -> bytes:
    """Runs of three or more equal bytes, and what stands between them."""
    values = np.frombuffer(row, np.uint8)
    edges = np.flatnonzero(np.diff(values)) + 1
    starts, ends = np.append(0, edges), np.append(edges, len(values))
    runs = ends - starts >= 3
    out, open_at = [], 0

    def literal(upto: int) -> None:
        for k in range(open_at, upto, 128):
            part = row[k : min(k + 128, upto)]
            out.append(bytes((len(part) - 1,)) + part)

    for start, end in zip(starts[runs].tolist(), ends[runs].tolist(), strict=True):
        literal(start)
        for k in range(start, end, 128):
            many = min(128, end - k)
            out.append(bytes((257 - many if many > 1 else 0, row[start])))
        open_at = end
    literal(len(row))
    return b"".join(out)


def encode(rows: np.ndarray, compression: int) -> bytes:
    if compression == PACKBITS:
        return b"".join(packbits_encode(r.tobytes()) for r in rows)
    return lzw_encode(rows.tobytes()) if compression == LZW else zlib.compress(rows.tobytes(), 1) if compression == DEFLATE else rows.tobytes()


def decode(data: bytes, compression: int, most: int = MOST) -> bytes:
    """The bytes of a strip or tile; deflate stops after the `most` that it should have."""
    if compression == PLAIN:
        return data
    if compression == PACKBITS:
        return packbits_decode(data)
    if compression == LZW:
        return lzw_decode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        inflater = zlib.decompressobj()
        out = inflater.decompress(data, most)
        if len(out) < most and not inflater.eof:
            raise ValueError("deflate data end early")
        return out
    raise ValueError(f"compression {compression}")


def store(payload: bytes, width: int = WIDTH) -> bytes:
    """A little-endian file of grey 8-bit pages, `width` samples wide; the payload's size is a multiple of that."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must fill rows")
    compression, differ, tiled = LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, at = [b"II*\0"], 8
    tail: list[bytes] = []
    pages = [image[k : k + PAGE_ROWS] for k in range(0, len(image), PAGE_ROWS)]
    links = []
    for page in pages:
        blocks = []
        step, across = (TILE[1], TILE[0]) if tiled else (STRIP_ROWS, width)
        for y in range(0, len(page), step):
            for x in range(0, width, across):
                block = page[y : y + step, x : x + across]
                if tiled and len(block) < step:
                    block = np.concatenate([block, np.zeros((step - len(block), across), np.uint8)])
                if differ:
                    block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
                blocks.append(encode(block, compression))
        places = []
        for b in blocks:
            places.append(at)
            tail.append(b + b"\0" * (len(b) % 2))
            at += len(tail[-1])
        fields = {"width": width, "height": len(page), "bits": 8, "compression": compression, "photometric": 1, "samples": 1, "predictor": 2 if differ else 1}
        listed = {"tile_offsets": places, "tile_counts": [len(b) for b in blocks]} if tiled else {"strip_offsets": places, "strip_counts": [len(b) for b in blocks]}
        fields |= {"tile_width": TILE[0], "tile_height": TILE[1]} if tiled else {"strip_rows": STRIP_ROWS}
        rows = {}
        for name, values in listed.items():
            if len(values) > 1:
                rows[name] = struct.pack("<HHII", TAGS[name], 4, len(values), at)
                tail.append(struct.pack(f"<{len(values)}I", *values))
                at += len(tail[-1])
            else:
                rows[name] = struct.pack("<HHII", TAGS[name], 4, 1, values[0])
        rows |= {n: struct.pack("<HHII", TAGS[n], 4, 1, v) for n, v in fields.items()}
        links.append((len(tail), at))
        entries = b"".join(rows[n] for n in sorted(rows, key=TAGS.get))
        tail.append(struct.pack("<H", len(rows)) + entries)  # the link to the next directory follows below
        at += 2 + len(entries) + 4
    for (k, _), after in zip(links, [*(p for _, p in links[1:]), 0], strict=True):
        tail[k] += struct.pack("<I", after)
    return b"".join([*out, struct.pack("<I", links[0][1]), *tail])


def read_pages(media: bytes) -> Iterator[Page]:
    """Every page of a file; the last may hold an error."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(media[:4])
    if order is None or len(media) < 8:
        yield Page(0, error="no TIFF header")
        return
    (at,), seen, number = struct.unpack_from(order + "I", media, 4), set(), 0
    while at:
        page = Page(number)
        try:
            if at in seen:
                raise ValueError("the directories form a ring")
            seen.add(at)
            (count,) = struct.unpack_from(order + "H", media, at)
            fields: dict[int, tuple[int, ...]] = {}
            for k in range(count):
                place = at + 2 + 12 * k
                tag, kind, many = struct.unpack_from(order + "HHI", media, place)
                if kind in TYPES:
                    form = f"{order}{many}{TYPES[kind]}"
                    inside = struct.calcsize(form) <= 4
                    fields[tag] = struct.unpack_from(form, media, place + 8 if inside else struct.unpack_from(order + "I", media, place + 8)[0])
            (at,) = struct.unpack_from(order + "I", media, at + 2 + 12 * count)
            decode_page(media, fields, page, order)
        except (ValueError, TypeError, LookupError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
            page.error, page.data, at = f"{type(e).__name__}: {e}", None, 0
        yield page
        number += 1


def undone(raw: bytes, rows: int, across: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """Samples of a strip or tile [row, place, byte], little-endian, after its predictor."""
    size = max(1, bits // 8)
    values = across * samples
    wide = -(-values * bits // 8)
    block = np.frombuffer(raw, np.uint8, rows * wide).reshape(rows, wide)
    if bits < 8:
        own = np.unpackbits(block, axis=1)[:, : wide * 8 // bits * bits].reshape(rows, -1, bits)
        return (own[:, :values] << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8).reshape(rows, values, 1)
    if predictor == FLOATING:
        # differences run through the whole row, which holds the highest byte of all values, then the next
        planes = np.cumsum(block.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, values)
        return planes[:, ::-1].transpose(0, 2, 1)
    kind = np.dtype(f"u{size}").newbyteorder(order)
    own = block.reshape(-1).view(kind).astype(kind.newbyteorder("<")).reshape(rows, across, samples)
    if predictor == HORIZONTAL:
        own = np.cumsum(own, axis=1, dtype=own.dtype)
    return np.ascontiguousarray(own).view(np.uint8).reshape(rows, values, size)


def decode_page(media: bytes, fields: dict[int, tuple[int, ...]], page: Page, order: str) -> None:
    one = lambda name, default=None: fields[TAGS[name]][0] if default is None else fields.get(TAGS[name], (default,))[0]
    sizes = {"width": one("width"), "height": one("height"), "samples": one("samples", 1), "strip height": one("strip_rows", 1), "tile width": one("tile_width", 1), "tile height": one("tile_height", 1)}
    if wrong := [n for n, v in sizes.items() if not 0 < v < 1 << 31 and (n, v) != ("strip height", (1 << 32) - 1)]:
        raise ValueError(f"{wrong[0]} of {sizes[wrong[0]]}")
    page.width, page.height, page.samples = sizes["width"], sizes["height"], sizes["samples"]
    page.compression, page.predictor, page.bits = (min(v, (1 << 31) - 1) for v in (one("compression", PLAIN), one("predictor", 1), one("bits", 1)))
    page.tiled = TAGS["tile_offsets"] in fields
    real = one("sample_format", 1) == REAL
    if len(set(fields.get(TAGS["bits"], (1,)))) > 1 or page.bits not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError("samples of unequal or odd sizes")
    if page.predictor not in (1, HORIZONTAL, FLOATING) or page.predictor == HORIZONTAL and page.bits < 8 or page.predictor == FLOATING and not (real and page.bits > 8):
        raise ValueError("a predictor that these samples cannot have")
    planes = page.samples if one("planar", 1) == 2 else 1
    together = page.samples // planes
    across, down = (one("tile_width"), one("tile_height")) if page.tiled else (page.width, min(page.height, one("strip_rows", page.height)))
    kind = "tile" if page.tiled else "strip"
    places, sizes = fields[TAGS[f"{kind}_offsets"]], fields[TAGS[f"{kind}_counts"]]
    columns, bands = -(-page.width // across), -(-page.height // down)
    if len(places) < columns * bands * planes:
        raise ValueError("strips or tiles are missing")
    size = max(1, page.bits // 8)
    whole = page.height * page.width * page.samples * size
    blocks = range(columns * bands * planes)
    held = sum(max(0, min(sizes[k], len(media) - places[k])) for k in blocks) * GROWS.get(page.compression, 1) * (8 // min(8, page.bits))
    if whole > min(MOST, held):
        raise ValueError(f"{whole} bytes of samples in strips or tiles that hold {held} at most")
    wide = -(-across * together * page.bits // 8) * down
    out = np.empty((page.height, page.width, page.samples, size), np.uint8)
    for k in blocks:
        plane, at = divmod(k, columns * bands)
        y, x = at // columns * down, at % columns * across
        rows = down if page.tiled else min(down, page.height - y)
        stored = media[places[k] : places[k] + sizes[k]]
        raw = decode(stored.translate(TURNED) if one("fill_order", 1) == 2 else stored, page.compression, wide)
        block = undone(raw, rows, across, together, page.bits, page.predictor, order).reshape(rows, across, together, size)
        block = block[: page.height - y, : page.width - x]
        out[y : y + block.shape[0], x : x + block.shape[1], plane : plane + together] = block
    page.data = out.reshape(page.height, -1)


def page_rows(media: bytes | None) -> Iterator[dict]:
    """The row of each page of a file."""
    for p in read_pages(media) if media else ():
        yield {"page": p.number, "width": p.width, "height": p.height, "samples": p.samples, "bits": p.bits, "compression": p.compression, "predictor": p.predictor, "tiled": p.tiled, "data": None if p.data is None else p.data.tobytes(), "error": p.error}


def pages(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per page: key, page, width, height, samples, bits, compression, predictor, tiled, data, error."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for own, stored in zip(column(batch, "_key"), column(batch, "_media"), strict=True):
                for row in page_rows(stored.as_py()):
                    rows.append(row | {key: own.as_py()})
                    size += len(row["data"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    out = f"page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, data binary, error string, `{key}` {kind}"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.sparkSession.createDataFrame([], out).schema)
    return df.select(F.col(key).alias("_key"), F.col(media).alias("_media")).mapInArrow(run, out)


def feature(rows: list[dict]) -> str:
    """Pages, mean and deviation in thousandths, and which of 64 equal parts are brighter than the mean."""
    data = np.frombuffer(b"".join(r["data"] for r in rows), np.uint8)
    parts = data[: len(data) // 64 * 64].reshape(64, -1).mean(1)
    bright = np.packbits(parts > parts.mean()).tobytes().hex()
    return f"{len(rows)}:{round(float(data.mean()) * 1000)}:{round(float(data.std()) * 1000)}:{bright}"


def round_trip(text: bytes) -> dict:
    """Stores a text as TIFF, reads the stored bytes back as page rows, and digests what these hold."""
    payload = text + b"\xff" * ((-len(text)) % WIDTH or (0 if text else WIDTH))
    media = store(payload)
    rows = list(page_rows(media))
    if bad := [r["error"] for r in rows if r["error"]]:
        raise ValueError(bad[0])
    digest, tail, size = hashlib.sha256(), b"", 0
    for r in rows:
        digest.update(r["data"])
        tail, size = (tail + r["data"])[-32:], size + len(r["data"])
    return {"n_bytes": len(text), "payload_bytes": size, "payload_sha256": digest.hexdigest(), "tail_crc32": zlib.crc32(tail), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(rows)}


def texts(docs: DataFrame) -> DataFrame:
    """Every text (null: empty) through round_trip()."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [round_trip((t or "").encode()) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id")} | {n: pa.array([r[n] for r in rows], k) for n, k in kinds.items()})

    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
