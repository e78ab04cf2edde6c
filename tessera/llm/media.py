"""Media columns: payloads stored as baseline JPEG, read back as DC-only luminance thumbnails in numpy.

`read_thumbnail` takes any baseline (SOF0) JPEG with 8-bit samples: it parses the markers, builds look-up tables from the
Huffman tables and decodes the scan. Restart intervals are independent, so all of them (of all images with the same
tables) are decoded in step, a block at a time, in numpy; of AC coefficients only the lengths matter. The luminance DC
terms, one of each 8x8 block, make the thumbnail.

`write_payload` stores bytes losslessly in that form: a grey image WIDTH blocks wide whose blocks are flat, so that each
DC term is a byte; the quantiser 8 makes the term exactly the sample. A row of blocks is a restart interval. A payload
beyond ROWS rows goes on in further images, one after the other.

Nulls and edges: a null text is empty; the empty payload is padded to 64 zero bytes; lone surrogates are kept.
Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
ROWS = 8184
#: Payload bytes that are coded at once.
GROUP = 1_000_000

#: Number of DC codes of each length 1 to 16 in the usual luminance table; its symbols are 0 to 11.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: The only AC symbol written is end of block.
AC_LENGTHS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)


def _codes(lengths, symbols) -> dict[int, tuple[int, int]]:
    """symbol -> (code, its length), codes counted up within each length."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(lengths, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _lookup(lengths, symbols) -> np.ndarray:
    """For each 16 bits ahead: length << 8 | symbol of the code they begin with; 0 if none."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in _codes(lengths, symbols).items():
        table[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


_TABLES = (
    _segment(0xDB, bytes([0, 8] + [1] * 63))
    + _segment(0xC4, bytes([0x00, *DC_LENGTHS, *DC_SYMBOLS]))
    + _segment(0xC4, bytes([0x10, *AC_LENGTHS, *AC_SYMBOLS]))
    + _segment(0xDD, WIDTH.to_bytes(2, "big"))
)
_SCAN = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
_DC = _codes(DC_LENGTHS, DC_SYMBOLS)
_DC_CODE = np.array([_DC[c][0] for c in range(9)], np.int64)
_DC_SIZE = np.array([_DC[c][1] for c in range(9)], np.int64)
_CATEGORY = np.array([int(d).bit_length() for d in range(256)], np.int64)


def _header(rows: int) -> bytes:
    frame = bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * WIDTH).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"\xff\xd8" + _TABLES + _segment(0xC0, frame) + _SCAN


def write_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of WIDTH bytes) as one or more JPEG images in a row."""
    rows_of = [r for p in payloads for n in [len(p) // WIDTH] for r in [min(ROWS, n - a) for a in range(0, n, ROWS)]]
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH).astype(np.int64) - 128
    change = np.diff(samples, axis=1, prepend=0)
    size = _CATEGORY[np.abs(change)]
    low = np.where(change < 0, change + (1 << size) - 1, change)
    word = (_DC_CODE[size] << size | low) << 1  # and the bit 0, end of block
    bits = _DC_SIZE[size] + size + 1
    end = bits.cumsum(1)
    row_bytes = -(-end[:, -1] // 8)
    start = np.concatenate([[0], row_bytes.cumsum()[:-1]])
    at = start[:, None] * 8 + end - bits
    spread = word << (24 - bits - (at & 7))
    first = (at >> 3).ravel()
    spread = spread.ravel()
    total = int(row_bytes.sum())
    coded = np.zeros(total + 3)
    for k in range(3):
        coded += np.bincount(first + k, spread >> 16 - 8 * k & 255, total + 3)
    coded = coded[:total].astype(np.uint8)
    spare = 8 * row_bytes - end[:, -1]
    coded[start + row_bytes - 1] |= ((1 << spare) - 1).astype(np.uint8)
    # A zero follows each 0xFF; two bytes after each row hold a restart marker or the end of the image.
    stuffed = coded == 0xFF
    row = np.repeat(np.arange(len(row_bytes)), row_bytes)
    where = np.arange(total) + stuffed.cumsum() - stuffed + 2 * row
    out = np.zeros(total + int(stuffed.sum()) + 2 * len(row_bytes), np.uint8)
    out[where] = coded
    tail = where[start + row_bytes - 1] + stuffed[start + row_bytes - 1] + 1
    last = np.cumsum(rows_of) - 1
    index = np.arange(len(row_bytes)) - np.repeat(last + 1 - np.array(rows_of), rows_of)
    out[tail] = 0xFF
    out[tail + 1] = 0xD0 + index % 8
    out[tail[last] + 1] = 0xD9
    scans, begin, images = out.tobytes(), 0, iter(zip(rows_of, (tail[last] + 2).tolist()))
    result = []
    for p in payloads:
        parts, left = [], len(p) // WIDTH
        while left:
            rows, stop = next(images)
            parts += [_header(rows), scans[begin:stop]]
            begin, left = stop, left - rows
        result.append(b"".join(parts))
    return result


@dataclass
class Image:
    """What the markers of one image say."""

    width: int
    height: int
    components: list[tuple[int, int, int]]  # horizontal and vertical sampling, quantisation table
    tables: bytes  # all that decoding needs, as a key
    quant: dict[int, int]
    huffman: dict[int, tuple]
    scan: list[tuple[int, int]]  # DC and AC table of each component
    restart: int
    data: bytes

    @property
    def luminance(self) -> int:
        return 0


def parse(stream: bytes, at: int = 0) -> tuple[Image, int]:
    """The image that begins at a byte, and where it ends."""
    if stream[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, quant, huffman, restart, frame, key = at + 2, {}, {}, 0, None, []
    while True:
        while stream[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(stream) or stream[at] != 0xFF:
            raise ValueError("marker expected")
        marker, size = stream[at + 1], int.from_bytes(stream[at + 2 : at + 4], "big")
        body, at = stream[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            key.append(body)
            while body:
                lengths = tuple(body[1:17])
                huffman[body[0]] = (lengths, tuple(body[17 : 17 + sum(lengths)]))
                body = body[17 + sum(lengths) :]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC0:
            frame = body
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDA:
            break
    if frame is None or frame[0] != 8:
        raise ValueError("no baseline frame of 8-bit samples")
    named = {frame[6 + 3 * k]: (frame[7 + 3 * k] >> 4, frame[7 + 3 * k] & 15, frame[8 + 3 * k]) for k in range(frame[5])}
    chosen = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
    if len(chosen) != len(named):
        raise ValueError("components in several scans")
    end = at
    while True:
        end = stream.find(b"\xff", end)
        if end < 0 or end + 1 >= len(stream):
            raise ValueError("scan without end")
        if stream[end + 1] == 0 or 0xD0 <= stream[end + 1] <= 0xD7:
            end += 2
        else:
            break
    image = Image(
        width=int.from_bytes(frame[3:5], "big"),
        height=int.from_bytes(frame[1:3], "big"),
        components=[named[c] for c, _ in chosen],
        tables=b"|".join([*key, frame[5:], body]),
        quant=quant,
        huffman=huffman,
        scan=[(t >> 4, 0x10 | t & 15) for _, t in chosen],
        restart=restart,
        data=stream[at:end],
    )
    while stream[end : end + 2] not in (b"\xff\xd9", b""):
        end = stream.find(b"\xff\xd9", end)
        if end < 0:
            raise ValueError("no end of image")
    return image, end + 2


def _grid(image: Image) -> tuple[int, int, list[tuple[int, int]]]:
    """MCUs across and down, and blocks (across, down) of each component in an MCU."""
    sampling = [(1, 1)] if len(image.components) == 1 else [(h, v) for h, v, _ in image.components]
    most_h = max(h for h, _, _ in image.components) if len(sampling) > 1 else 1
    most_v = max(v for _, v, _ in image.components) if len(sampling) > 1 else 1
    return -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v)), sampling


def _dc_terms(images: list[Image]) -> list[np.ndarray]:
    """Luminance DC terms of images with the same tables, (MCUs, blocks in an MCU) each."""
    first = images[0]
    look = {k: _lookup(*v) for k, v in first.huffman.items()}
    sampling = _grid(first)[2]
    order = [(c, *first.scan[c]) for c, (h, v) in enumerate(sampling) for _ in range(h * v)]
    lum = [t for t, (c, _, _) in enumerate(order) if c == first.luminance]
    raw = np.frombuffer(b"".join(i.data + b"\xff\xd0" for i in images) + bytes(8), np.uint8)
    follows = np.zeros(len(raw), bool)
    follows[1:] = raw[:-1] == 0xFF
    marker = follows & (raw != 0)
    keep = ~follows
    keep[:-1] &= ~marker[1:]
    data = raw[keep]
    new_at = keep.cumsum()
    stops = new_at[np.flatnonzero(marker)]  # data bytes before each marker
    starts = np.concatenate([[0], stops[:-1]])
    counts = []
    for image in images:
        across, down, _ = _grid(image)
        total = across * down
        step = image.restart or total
        counts += [min(step, total - a) for a in range(0, total, step)]
    counts = np.array(counts)
    if len(counts) != len(starts):
        raise ValueError("restart markers don't match the size")
    b = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    ahead = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    limit = 8 * (len(ahead) - 3)

    def peek(at: np.ndarray) -> np.ndarray:
        return ahead[at >> 3] >> (16 - (at & 7)).astype(np.uint32) & 0xFFFF

    by_count = np.argsort(-counts, kind="stable")
    position = starts[by_count].astype(np.int64) * 8
    sizes = counts[by_count]
    before = np.zeros((len(counts), len(sampling)), np.int64)
    terms = np.zeros((len(counts), int(sizes[0]) if len(sizes) else 0, len(lum)), np.int32)
    for mcu in range(terms.shape[1]):
        n = int(np.searchsorted(-sizes, -mcu, side="left"))
        at = position[:n]
        for t, (c, dc, ac) in enumerate(order):
            code = look[dc][peek(at)]
            at = at + (code >> 8)
            size = code & 255
            value = (peek(at) >> (16 - size).astype(np.uint32)).astype(np.int64)
            at = at + size
            before[:n, c] += np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
            if c == first.luminance:
                terms[:n, mcu, lum.index(t)] = before[:n, c]
            code = look[ac][peek(at)]
            at = at + (code >> 8)
            rest = np.flatnonzero(code & 255)
            k = np.zeros(n, np.int32)
            while len(rest):
                symbol = code[rest] & 255
                at[rest] += symbol & 15
                k[rest] += (symbol >> 4) + 1
                rest = rest[k[rest] < 63]
                code[rest] = look[ac][peek(at[rest])]
                at[rest] += code[rest] >> 8
                rest = rest[(code[rest] & 255) != 0]
            if (at > limit).any() or (code == 0).any():
                raise ValueError("scan is cut short or holds no code")
        position[:n] = at
    back = np.empty(len(counts), np.int64)
    back[by_count] = np.arange(len(counts))
    out, row = [], 0
    for image in images:
        across, down, _ = _grid(image)
        n = -(-across * down // (image.restart or across * down))
        part = back[row : row + n]
        out.append(np.concatenate([terms[p, : counts[row + k]] for k, p in enumerate(part)]) if (counts[row : row + n] != terms.shape[1]).any() else terms[part].reshape(-1, len(lum)))
        row += n
    return out


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """The luminance of each image at one sample a block, uint8."""
    groups: dict[bytes, list[int]] = {}
    for k, image in enumerate(images):
        groups.setdefault(image.tables, []).append(k)
    out: list = [None] * len(images)
    for members in groups.values():
        for k, terms in zip(members, _dc_terms([images[k] for k in members])):
            image = images[k]
            across, down, sampling = _grid(image)
            h, v = sampling[image.luminance]
            blocks = terms.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            step = image.quant[image.components[image.luminance][2]]
            out[k] = np.clip(np.rint(blocks * step / 8) + 128, 0, 255).astype(np.uint8)[: -(-image.height // 8) if len(sampling) > 1 else None, : -(-image.width // 8) if len(sampling) > 1 else None]
    return out


def read_thumbnail(stream: bytes) -> np.ndarray:
    return thumbnails([parse(stream)[0]])[0]


def read_payloads(streams: list[bytes]) -> list[np.ndarray]:
    """The thumbnails of each stream's images, one below the other."""
    images, counts = [], []
    for s in streams:
        at = n = 0
        while at < len(s):
            image, at = parse(s, at)
            images.append(image)
            n += 1
        counts.append(n)
    made, out = iter(thumbnails(images)), []
    for n in counts:
        parts = [next(made) for _ in range(n)]
        out.append(parts[0] if n == 1 else np.concatenate(parts))
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 reduction are brighter than their mean."""
    rows = np.add.reduceat(thumb.astype(np.float64), np.arange(0, thumb.shape[1], max(thumb.shape[1] // 8, 1))[:8], axis=1)
    edges = np.linspace(0, len(thumb), 9).astype(int)
    sums = np.concatenate([np.zeros((1, rows.shape[1])), rows.cumsum(0)])
    high = np.maximum(edges[1:], np.minimum(edges[:-1] + 1, len(thumb)))
    low = np.minimum(edges[:-1], high - 1)
    cells = (sums[high] - sums[low]) / (high - low)[:, None]
    return f"{int.from_bytes(np.packbits(cells > cells.mean()).tobytes(), 'big'):016x}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def _features(doc: int, n: int, media: bytes, thumb: np.ndarray) -> tuple:
    read = thumb.tobytes()
    height, width = thumb.shape
    return (
        doc, n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(media), hashlib.sha256(media).hexdigest(),
        f"{8 * width}x{8 * height}:{thumbnail_hash(thumb)}", 8 * width, 8 * height,
    )


def store(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Each document's stored image(s) and what reading them back gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = 0
            while k < batch.num_rows:
                docs_, sizes, payloads, total = [], [], [], 0
                while k < batch.num_rows and (total < GROUP or not payloads):
                    n, payload = payload_of(batch.column(1)[k].as_py())
                    docs_.append(batch.column(0)[k].as_py())
                    sizes.append(n)
                    payloads.append(payload)
                    total += len(payload)
                    k += 1
                media = write_payloads(payloads)
                rows = [_features(d, n, m, t) for d, n, m, t in zip(docs_, sizes, media, read_payloads(media))]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(media, pa.binary())] if with_media else [])], schema=schema if not with_media else schema.append(pa.field("media", pa.binary())))

    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in FIELDS.split(", "))])
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, FIELDS + (", media binary" if with_media else ""))


def digest(docs: DataFrame) -> DataFrame:
    return store(docs, with_media=False)
