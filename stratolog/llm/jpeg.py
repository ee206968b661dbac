"""Media columns: lossless payloads in baseline JPEG, DC-only luminance thumbnails and their hashes.

A payload byte is one 8 x 8 block of a grey picture, 192 blocks to a row: its DC coefficient is the byte minus 128 under a quantiser of 8, its AC
coefficients end at once.  Any baseline decoder shows the byte as the block's flat sample value, so the DC-only thumbnail is the payload.  Each row of
blocks is a restart interval; numpy encodes and decodes all intervals of a block of documents side by side, one Huffman symbol at a time.  A payload
beyond ``MOST_ROWS`` rows continues in a further picture appended to the first.

The reader takes any baseline stream: one or several components with sampling factors, interleaved or not, with or without restart intervals, several tables
in a marker, 8- or 16-bit quantisers.  Streams whose rows of blocks are restart intervals, as those written here, are decoded side by side in numpy; others
one symbol after the other.  Of each picture only the DC coefficients of the first component (luminance) are kept, one sample for each of its blocks.
``thumbnails`` reads a column of pictures; what is null, no JPEG, not baseline or cut short has nulls in all columns made here.

Null and empty texts are 192 spaces.  Long texts are stored whole.  Equal texts give equal values; rows are independent, an empty table gives an empty
result, and of other columns only those named are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, utf8

WIDTH = 192
MOST_ROWS = 8000
#: Code length of each DC difference category; the differences of bytes need nine.
DC_LENGTHS = {4: 2, 2: 3, 3: 3, 7: 3, 0: 3, 1: 4, 5: 4, 6: 4, 8: 5}
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), in the order of a DHT segment."""
    codes, code, last = {}, 0, 0
    for symbol, length in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= length - last
        codes[symbol], last = (code, length), length
        code += 1
    return codes


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    symbols = [s for s, _ in sorted(lengths.items(), key=lambda x: (x[1], x[0]))]
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return struct.pack(">HHB", 0xFFC4, 19 + len(symbols), kind << 4) + bytes(counts) + bytes(symbols)


def header(rows: int) -> bytes:
    """SOI to SOS of a picture of ``rows`` rows of blocks."""
    sof = struct.pack(">HHBHHBBBB", 0xFFC0, 11, 8, rows * 8, WIDTH * 8, 1, 1, 0x11, 0)
    dqt = struct.pack(">HHB", 0xFFDB, 67, 0) + bytes([8] * 64)
    dri, sos = struct.pack(">HHH", 0xFFDD, 4, WIDTH), struct.pack(">HHBBBBBB", 0xFFDA, 8, 1, 1, 0, 0, 63, 0)
    return b"\xff\xd8" + dqt + sof + _dht(0, DC_LENGTHS) + _dht(1, {0: 1}) + dri + sos


_CODES = _canonical(DC_LENGTHS)
_CODE, _LENGTH = (np.array([_CODES.get(c, (0, 0))[k] for c in range(9)], np.int64) for k in (0, 1))
_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)], np.int64)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG stream for each payload (a positive multiple of 192 bytes each)."""
    rows = np.array([len(p) // WIDTH for p in payloads])
    grid = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH).astype(np.int64) - 128
    diff = np.diff(grid, axis=1, prepend=0)
    category = _CATEGORY[diff + 255]
    bits = _LENGTH[category] + category + 1  # the last bit is the end-of-block code, 0
    symbol = ((_CODE[category] << category) | np.where(diff < 0, diff + (1 << category) - 1, diff)) << 1
    ends = np.cumsum(bits, 1)
    starts, n_bytes = ends - bits, (ends[:, -1] + 7) >> 3
    packed = np.zeros((len(grid), int(n_bytes.max()) + 3), np.uint8)
    flat, base = packed.reshape(-1), np.arange(len(grid)) * packed.shape[1]
    for j in range(WIDTH):
        at = base + (starts[:, j] >> 3)
        value = symbol[:, j] << (24 - bits[:, j] - (starts[:, j] & 7))
        for k in range(3):
            flat[at + k] |= (value >> (16 - 8 * k)).astype(np.uint8)
    flat[base + n_bytes - 1] |= ((1 << (-ends[:, -1] & 7)) - 1).astype(np.uint8)  # fill with ones
    packed = packed[np.arange(packed.shape[1]) < n_bytes[:, None]]
    # stuff a zero after each 0xFF, and end each row with a marker: RSTm, or EOI at the end of a picture
    stuffed = packed == 255
    owner = np.repeat(np.arange(len(grid)), n_bytes)
    size = n_bytes + np.bincount(owner[stuffed], minlength=len(grid)) + 2
    after = np.cumsum(size)
    out = np.zeros(after[-1], np.uint8)
    place = np.arange(len(packed)) + np.cumsum(stuffed) - stuffed + 2 * owner
    out[place] = packed
    row_of = np.arange(len(grid)) - np.repeat(np.cumsum(rows) - rows, rows)
    picture_row = row_of % MOST_ROWS
    final = np.zeros(len(grid), bool)
    final[np.cumsum(rows) - 1] = True
    final |= picture_row == MOST_ROWS - 1
    out[after - 2] = 255
    out[after - 1] = np.where(final, 0xD9, 0xD0 + picture_row % 8)
    streams, row = [], 0
    for n in rows:
        parts = []
        for lo in range(0, n, MOST_ROWS):
            hi = min(n, lo + MOST_ROWS)
            parts += [header(hi - lo), out[after[row + lo] - size[row + lo] : after[row + hi - 1]].tobytes()]
        streams.append(b"".join(parts))
        row += n
    return streams


_SCAN_END = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


@dataclass(frozen=True)
class Component:
    number: int
    across: int  # sampling factors
    down: int
    quantiser: int


@dataclass
class Picture:
    """Dimensions and tables of a picture, and its scans: (components with their DC and AC tables, restart interval, bytes)."""

    width: int = 0
    height: int = 0
    components: tuple[Component, ...] = ()
    scans: list[tuple] = field(default_factory=list)

    def blocks(self, part: Component) -> tuple[int, int]:
        """Rows and columns of blocks that hold samples of the component."""
        most_across, most_down = max(c.across for c in self.components), max(c.down for c in self.components)
        samples = -(-self.height * part.down // most_down), -(-self.width * part.across // most_across)
        return -(-samples[0] // 8), -(-samples[1] // 8)


def parse(stream: bytes, at: int = 0) -> tuple[Picture, int]:
    """The picture that begins at ``at``, and where it ends.  Raises ValueError for what is not a whole baseline picture."""
    if stream[at : at + 2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    at += 2
    found, quantisers, huffman, interval = Picture(), {}, {}, 0
    while True:
        while stream[at : at + 2] == b"\xff\xff":  # fill bytes
            at += 1
        kind = stream[at + 1] if stream[at : at + 1] == b"\xff" and at + 1 < len(stream) else -1
        if kind == 0xD9:
            if not found.scans:
                raise ValueError("no scan")
            return found, at + 2
        length = int.from_bytes(stream[at + 2 : at + 4], "big")
        body = stream[at + 4 : at + 2 + length]
        if kind < 0xC0 or length < 2 or len(body) != length - 2:
            raise ValueError("no marker, or one that is cut short")
        if kind in (0xC0, 0xC1):
            if len(body) < 6 or len(body) < 6 + 3 * body[5] or body[0] != 8 or not body[5]:
                raise ValueError("not a picture of 8-bit samples")
            found.height, found.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            found.components = tuple(Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3))
            if not found.height or not found.width or not all(1 <= f <= 4 for c in found.components for f in (c.across, c.down)):
                raise ValueError("dimensions are missing")
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline picture")
        elif kind == 0xDB:
            while body:  # several tables, of one or two bytes a value; only the DC value is needed
                wide = 1 + (body[0] >> 4 > 0)
                quantisers[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                body = body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                if len(body) < size:
                    raise ValueError("a table is cut short")
                huffman[body[0]] = body[1:size]
                body = body[size:]
        elif kind == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        at += 2 + length
        if kind == 0xDA:
            by_number = {c.number: c for c in found.components}
            parts = []
            for k in range(1, 1 + 2 * body[0], 2):
                part, tables = by_number.get(body[k]), body[k + 1]
                dc, ac = huffman.get(tables >> 4), huffman.get(16 | tables & 15)
                if part is None or dc is None or ac is None or part.quantiser not in quantisers:
                    raise ValueError("a scan names what is not there")
                parts.append((part, dc, ac, quantisers[part.quantiser]))
            end = _SCAN_END.search(stream, at)
            if end is None:
                raise ValueError("a scan has no end")
            found.scans.append((tuple(parts), interval, stream[at : end.start()]))
            at = end.start()


@lru_cache(64)
def _lookup(dht: bytes) -> np.ndarray:
    """For each 16 bits that may follow: code length << 8 | symbol (0 where no code begins so)."""
    table, code, at = np.zeros(65536, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(dht[length - 1]):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | dht[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _dc_values(data: bytes, layout: list[tuple[int, list, list]], units: int) -> list[list[int]]:
    """Per component the DC coefficients of ``units`` units of blocks; layout: (component, DC table, AC table) of each block of a unit."""
    n_bits = 8 * len(data)
    data += bytes(8)
    at, last = 0, [0] * (1 + max(c for c, _, _ in layout))
    out: list[list[int]] = [[] for _ in last]
    for _ in range(units):
        for part, dc, ac in layout:
            hit = dc[int.from_bytes(data[at >> 3 : (at >> 3) + 3], "big") >> 8 - (at & 7) & 0xFFFF]
            at += hit >> 8
            size = hit & 255
            if not hit or size > 16:
                raise ValueError("no DC code")
            if size:
                value = int.from_bytes(data[at >> 3 : (at >> 3) + 3], "big") >> 24 - size - (at & 7) & (1 << size) - 1
                last[part] += value if value >> size - 1 else value - (1 << size) + 1
                at += size
            out[part].append(last[part])
            k = 1
            while k < 64:
                hit = ac[int.from_bytes(data[at >> 3 : (at >> 3) + 3], "big") >> 8 - (at & 7) & 0xFFFF]
                if not hit:
                    raise ValueError("no AC code")
                at += (hit >> 8) + (hit & 15)
                if not hit & 255:
                    break
                k += (hit >> 4 & 15) + 1
            if at > n_bits:
                raise ValueError("a scan is cut short")
    return out


def _luminance(picture: Picture) -> np.ndarray:
    """One sample for each block of the picture's first component."""
    wanted = picture.components[0]
    for parts, interval, data in picture.scans:
        mine = [k for k, p in enumerate(parts) if p[0] == wanted]
        if not mine:
            continue
        if len(parts) == 1:  # the unit is a block
            (rows, columns), down, across = picture.blocks(wanted), 1, 1
            layout = [(0, _lookup(parts[0][1]).tolist(), _lookup(parts[0][2]).tolist())]
        else:
            most_down, most_across = max(c.down for c in picture.components), max(c.across for c in picture.components)
            rows, columns = -(-picture.height // (8 * most_down)), -(-picture.width // (8 * most_across))
            down, across = wanted.down, wanted.across
            layout = []
            for k, (part, dc, ac, _) in enumerate(parts):
                layout += [(k, _lookup(dc).tolist(), _lookup(ac).tolist())] * (part.across * part.down)
        left, values = rows * columns, []
        for piece in _RESTART.split(data):
            units = min(left, interval or left)
            if units:
                values += _dc_values(piece.replace(b"\xff\x00", b"\xff"), layout, units)[mine[0]]
            left -= units
        if left:
            raise ValueError("intervals are missing")
        grid = np.array(values, np.int64).reshape(rows, columns, down, across).transpose(0, 2, 1, 3).reshape(rows * down, columns * across)
        tall, wide = picture.blocks(wanted)
        return _samples(grid[:tall, :wide], parts[mine[0]][3])
    raise ValueError("the first component has no scan")


def _samples(dc: np.ndarray, quantiser: int) -> np.ndarray:
    return np.clip((dc * quantiser + 4) // 8 + 128, 0, 255).astype(np.uint8)


def _pictures(stream: bytes) -> list[Picture]:
    found, at = [], 0
    while at < len(stream):
        picture, at = parse(stream, at)
        found.append(picture)
    if not found:
        raise ValueError("no picture")
    return found


def _side_by_side(pictures: list[Picture]) -> bool:
    """Whether all pictures have one component, the same tables and width, and a restart interval for each row of blocks."""
    first = pictures[0]
    (parts, interval, _), *_ = first.scans
    return all(
        len(p.components) == 1 and len(p.scans) == 1 and p.width == first.width and p.scans[0][0] == parts and p.scans[0][1] == interval == -(-p.width // 8) for p in pictures
    )


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The DC-only luminance of each stream: one sample per block, in rows of blocks (pictures of one stream, of equal width, below each other)."""
    each = [_pictures(s) for s in streams]
    pictures = [p for some in each for p in some]
    if not pictures or not _side_by_side(pictures):
        return [np.concatenate([_luminance(p) for p in some]) for some in each]
    luminance = _rows(pictures)
    return np.split(luminance, np.cumsum([sum(p.blocks(p.components[0])[0] for p in some) for some in each])[:-1])


def _rows(pictures: list[Picture]) -> np.ndarray:
    """The samples of pictures whose rows are restart intervals, below each other; all rows are decoded at once, one symbol at a time."""
    (_, dc, ac, quantiser), across = pictures[0].scans[0][0][0], -(-pictures[0].width // 8)
    raw = np.frombuffer(b"".join(p.scans[0][2] + b"\xff\xd9" for p in pictures), np.uint8)
    follows = np.flatnonzero(raw[:-1] == 255) + 1
    ends = follows[raw[follows] != 0] - 1  # where a row's marker begins
    if len(ends) != sum(p.blocks(p.components[0])[0] for p in pictures):
        raise ValueError("intervals are missing")
    drop = np.zeros(len(raw), bool)
    drop[follows] = True
    drop[ends] = True
    begin = np.concatenate([[0], ends[:-1] + 2])
    gone = np.concatenate([[0], np.cumsum(drop)])
    data = np.concatenate([raw[~drop], np.zeros(4, np.uint8)]).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    position = (begin - gone[begin]) * 8
    del data, raw, drop, gone
    dc, ac = _lookup(dc), _lookup(ac)

    def peek(at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (((window[np.minimum(at >> 3, len(window) - 1)].astype(np.int64) << (at & 7)) & 0xFFFFFFFF) >> (32 - n)).astype(np.int64)

    diffs = np.zeros((len(position), across), np.int64)
    for j in range(across):
        hit = dc[peek(position, 16)]
        if not hit.all():
            raise ValueError("no DC code")
        position = position + (hit >> 8)
        size = hit & 255
        value = peek(position, size)
        diffs[:, j] = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
        position = position + size
        open_, done = np.arange(len(position)), np.ones(len(position), np.int64)
        while len(open_):  # AC coefficients are read over
            hit = ac[peek(position[open_], 16)]
            if not hit.all():
                raise ValueError("no AC code")
            symbol = hit & 255
            position[open_] += (hit >> 8) + (symbol & 15)
            done[open_] += (symbol >> 4) + 1
            open_ = open_[(symbol != 0) & (done[open_] < 64)]
    return _samples(np.cumsum(diffs, 1), quantiser)


def thumbnail_hash(luminance: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 thumbnail are lighter than its mean."""
    down, across = (np.arange(9) * n // 8 for n in luminance.shape)
    strips = np.stack([luminance[a : max(a + 1, b)].mean(0) for a, b in zip(down, down[1:])])
    cells = np.stack([strips[:, a : max(a + 1, b)].mean(1) for a, b in zip(across, across[1:])], 1)
    return np.packbits(cells > cells.mean()).tobytes().hex()


def _thumbnail(stream: bytes | None) -> tuple:
    """(width, height, thumbnail's width, height and bytes, hash) of a stream, or nulls."""
    if stream is None:
        return (None,) * 6
    try:
        pictures = _pictures(stream)
        luminance = decode([stream])[0]
    except (ValueError, IndexError):  # what the reader says of streams that it cannot read
        return (None,) * 6
    return pictures[0].width, sum(p.height for p in pictures), luminance.shape[1], luminance.shape[0], luminance.tobytes(), thumbnail_hash(luminance)


def thumbnails(rows: DataFrame, column: str = "media", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, and of the picture in ``column``: width, height, thumb_width, thumb_height, thumbnail (a byte per sample) and thumbnail_hash."""
    schema = rows.select(*carry).schema
    made = (("width", "integer"), ("height", "integer"), ("thumb_width", "integer"), ("thumb_height", "integer"), ("thumbnail", "binary"), ("thumbnail_hash", "string"))
    for name, kind in made:
        schema = schema.add(name, kind)
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(_thumbnail(x.as_py()) for x in batch.column("media")))) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carry))), *(pa.array(c, t) for c, t in zip(found, kinds))], schema.names)

    return rows.select(*carry, F.col(column).cast("binary").alias("media")).mapInArrow(run, schema)


def padded(text: bytes) -> bytes:
    return text + b" " * (WIDTH - len(text) if not text else -len(text) % WIDTH)


def _store(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        columns: list[list] = [[] for _ in range(8)]
        for lo, hi in blocks(offsets, 1 << 20):
            payloads = [padded(data[offsets[k] : offsets[k + 1]].tobytes()) for k in range(lo, hi)]
            media = encode(payloads)
            for k, (stream, luminance) in enumerate(zip(media, decode(media)), lo):
                back = luminance.tobytes()
                feature = f"{luminance.shape[1] * 8}x{luminance.shape[0] * 8}:{thumbnail_hash(luminance)}"
                row = (int(offsets[k + 1] - offsets[k]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, stream if keep else None)
                for column, x in zip(columns, row):
                    column.append(x)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
        arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))]
        yield pa.RecordBatch.from_arrays(arrays if keep else arrays[:-1], names if keep else names[:-1])


def store(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Each text's stored picture (column ``media``, if kept) with what was read back from it."""
    schema = SCHEMA + (", media binary" if keep_media else "")
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lambda batches: _store(batches, keep_media), schema)
