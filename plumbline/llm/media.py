"""Media columns: payloads kept as baseline JPEG, read back by an own decoder, with DC-only thumbnails and their hashes.

A payload byte is one quantised DCT coefficient of size category 8 (the byte is the coefficient's magnitude bits), 64 to a
block in zigzag order, all quantisers 1; every block is a restart interval of its own, so DC values are not differences
of differences and blocks can be decoded side by side. The decoder takes any baseline Huffman-coded JPEG: it parses the
markers, removes stuffing, and steps through the coefficients of all restart intervals of a chunk at once (numpy).

Defined cases: null text is empty; an empty payload is 64 zero bytes; equal texts give equal values; repeated rows and null
ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textvec import chunks, text_buffer

BLOCK = 64


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman_body(kind: int, by_length: dict[int, list[int]]) -> bytes:
    return bytes([kind << 4]) + bytes(len(by_length.get(n, [])) for n in range(1, 17)) + bytes(s for n in range(1, 17) for s in by_length.get(n, []))


_DQT = _segment(0xDB, b"\0" + b"\1" * 64)
_DHT = _segment(0xC4, _huffman_body(0, {1: [8]})) + _segment(0xC4, _huffman_body(1, {1: [0x08], 2: [0x00], 3: [0xF0]}))
_DRI = _segment(0xDD, struct.pack(">H", 1))
_SOS = _segment(0xDA, b"\1\1\0\0\x3f\0")


def grid(blocks: int) -> tuple[int, int]:
    wide = math.isqrt(blocks - 1) + 1
    return wide, -(-blocks // wide)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload (a positive multiple of 64 bytes)."""
    grids = [grid(len(p) // BLOCK) for p in payloads]
    blocks = np.array([w * h for w, h in grids])
    padded = b"".join(p.ljust(n * BLOCK, b"\0") for p, n in zip(payloads, blocks.tolist(), strict=True))
    values = np.frombuffer(padded, np.uint8)
    bits = np.zeros((len(values), 9), np.uint8)  # every symbol has the code 0, then the byte itself
    bits[:, 1:] = np.unpackbits(values.reshape(-1, 1), axis=1)
    coded = np.packbits(bits)  # 72 bytes a block
    n_blocks = len(values) // BLOCK
    stuffed = coded == 0xFF
    at = np.arange(len(coded)) + np.concatenate([[0], np.cumsum(stuffed)[:-1]]) + 2 * (np.arange(len(coded)) // 72)
    out = np.zeros(len(coded) + int(stuffed.sum()) + 2 * n_blocks, np.uint8)
    out[at] = coded
    ends = np.append(at[72::72], len(out)) - 2  # the marker that follows each block
    first = np.concatenate([[0], np.cumsum(blocks)])
    within = np.arange(n_blocks) - np.repeat(first[:-1], blocks)
    out[ends], out[ends + 1] = 0xFF, 0xD0 + within % 8
    out[ends[first[1:] - 1] + 1] = 0xD9
    stops = ends[first[1:] - 1] + 2
    raw, images, start = out.tobytes(), [], 0
    for p, (w, h), stop in zip(payloads, grids, stops.tolist(), strict=True):
        sof = _segment(0xC0, struct.pack(">BHHB", 8, 8 * h, 8 * w, 1) + b"\1\x11\0")
        head = b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(p)) + _DQT + sof + _DHT + _DRI + _SOS
        images.append(head + raw[start:stop])
        start = stop
    return images


class Header:
    """What the markers of a baseline JPEG say."""

    def __init__(self, image: bytes):
        if image[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.quant: dict[int, list[int]] = {}
        self.tables: dict[int, bytes] = {}
        self.comment, self.interval, at = b"", 0, 2
        while True:
            while image[at + 1] == 0xFF:
                at += 1
            marker, size = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
            body, at = image[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = list(struct.unpack_from(">64H" if wide else ">64B", body, 1))
                    body = body[129 if wide else 65 :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xC0:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                self.scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                self.data = at
                break
        if len(self.parts) == 1:
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        self.h = max(p[1] for p in self.parts)
        self.v = max(p[2] for p in self.parts)
        self.mcus = (-(-self.width // (8 * self.h)), -(-self.height // (8 * self.v)))
        #: For each block of an MCU: component, DC table, AC table.
        self.layout = [(c, *self.scan[p[0]]) for c, p in enumerate(self.parts) for _ in range(p[1] * p[2])]

    def key(self) -> tuple:
        used = sorted({x for _, d, a in self.layout for x in (d, 16 + a)})
        return tuple(self.layout), tuple((k, self.tables[k]) for k in used)


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for each 16 bits that may follow; length 0: no code."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, k = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            a = code << (16 - n)
            symbol[a : a + (1 << (16 - n))], length[a : a + (1 << (16 - n))] = table[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


def decode_intervals(stream: np.ndarray, starts: np.ndarray, blocks: np.ndarray, layout: list, tables: dict) -> np.ndarray:
    """Quantised coefficients (zigzag order) of all blocks of restart intervals that share a layout and tables.

    `stream`: bytes without stuffing; `starts`: each interval's first byte; `blocks`: its blocks. Row order: interval, block.
    """
    look = {k: lookup(t) for k, t in tables.items()}
    wide = np.concatenate([stream, np.zeros(4, np.uint8)]).astype(np.int64)
    wide = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    bit = starts.astype(np.int64) * 8
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros((int(first[-1]), 64), np.int16)
    previous = np.zeros((max(c for c, *_ in layout) + 1, len(starts)), np.int64)

    def take(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return ((wide[at >> 3] >> (8 - (at & 7))) & 0xFFFF) >> (16 - n)

    def extend(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)

    for b in range(int(blocks.max()) if len(blocks) else 0):
        part, dc, ac = layout[b % len(layout)]
        live = np.flatnonzero(blocks > b)
        at, row = bit[live], first[live] + b
        symbol, length = look[dc]
        peek = (wide[at >> 3] >> (8 - (at & 7))) & 0xFFFF
        size, n = symbol[peek], length[peek]
        if not n.all():
            raise ValueError("a bit string that is no Huffman code")
        at = at + n
        previous[part, live] += extend(take(at, size), size)
        at += size
        out[row, 0] = previous[part, live]
        symbol, length = look[16 + ac]
        k = np.ones(len(live), np.int64)
        going = np.arange(len(live))
        while len(going):
            here = at if len(going) == len(live) else at[going]
            peek = (wide[here >> 3] >> (8 - (here & 7))) & 0xFFFF
            s, n = symbol[peek], length[peek]
            if not n.all():
                raise ValueError("a bit string that is no Huffman code")
            size, run = s & 15, s >> 4
            here = here + n
            value = extend(take(here, size), size)
            here += size
            place = (k if len(going) == len(live) else k[going]) + run
            has = size > 0
            if has.all():
                out[row[going], np.minimum(place, 63)] = value
            else:
                out[row[going][has], np.minimum(place[has], 63)] = value[has]
            end = ~has & (run != 15)
            at[going], k[going] = here, np.where(end, 64, place + 1)
            going = going[k[going] < 64]
        bit[live] = at
    return out


def decode_many(images: list[bytes]) -> list[tuple[Header, np.ndarray]]:
    """Header and coefficients (blocks in scan order, 64 each) of every image."""
    heads = [Header(x) for x in images]
    result: list = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault(h.key(), []).append(i)
    for (layout, tables), members in groups.items():
        raw = b"".join(images[i][heads[i].data :] for i in members)
        data = np.frombuffer(raw, np.uint8)
        ff = np.flatnonzero(data[:-1] == 0xFF)
        code = data[ff + 1]
        marks = ff[(code >= 0xD0) & (code <= 0xD9)]
        is_end = data[marks + 1] == 0xD9
        drop = np.zeros(len(data), bool)
        drop[ff[code == 0] + 1] = True
        drop[marks] = drop[marks + 1] = True
        kept = np.concatenate([[0], np.cumsum(~drop)])
        stops = np.cumsum([len(images[i]) - heads[i].data for i in members])
        begin = np.concatenate([[0], stops[:-1]])
        inner = marks[~is_end] + 2
        starts = np.sort(np.concatenate([begin, inner]))
        of = np.searchsorted(stops, starts, "right")
        per = len(layout)
        total = np.array([heads[i].mcus[0] * heads[i].mcus[1] for i in members])
        step = np.array([heads[i].interval for i in members])
        step = np.where(step, step, total)
        nth = np.arange(len(starts)) - np.searchsorted(of, of)
        blocks = np.minimum(step[of], total[of] - nth * step[of]) * per
        coefs = decode_intervals(data[~drop], kept[starts], blocks, list(layout), dict(tables))
        at = np.concatenate([[0], np.cumsum(total * per)])
        for j, i in enumerate(members):
            result[i] = (heads[i], coefs[at[j] : at[j + 1]])
    return result


def thumbnail(head: Header, coefs: np.ndarray) -> np.ndarray:
    """DC-only luminance: one pixel for each 8 x 8 block of the first component."""
    part = head.parts[0]
    across, down = part[1], part[2]
    per = len(head.layout)
    dc = coefs[:, 0].astype(np.int64).reshape(-1, per)[:, : across * down] * head.quant[part[3]][0]
    wide, high = head.mcus
    pixels = dc.reshape(high, wide, down, across).transpose(0, 2, 1, 3).reshape(high * down, wide * across)
    return np.clip((pixels + 4) // 8 + 128, 0, 255).astype(np.uint8)


def feature(thumb: np.ndarray) -> str:
    """Size in pixels, a 64-bit average hash over an 8 x 8 grid of the thumbnail, and the thumbnail's CRC-32."""
    high, wide = thumb.shape
    total = np.zeros((high + 1, wide + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    y, x = np.arange(9) * high // 8, np.arange(9) * wide // 8
    y1, x1 = np.maximum(y[1:], y[:-1] + 1), np.maximum(x[1:], x[:-1] + 1)
    y0, x0 = np.minimum(y[:-1], high - 1), np.minimum(x[:-1], wide - 1)
    area = (np.minimum(y1, high) - y0)[:, None] * (np.minimum(x1, wide) - x0)[None, :]
    y1, x1 = np.minimum(y1, high)[:, None], np.minimum(x1, wide)[None, :]
    mean = (total[y1, x1] - total[y0[:, None], x1] - total[y1, x0[None, :]] + total[y0[:, None], x0[None, :]]) / area
    bits = np.packbits((mean > mean.mean()).ravel()).tobytes().hex()
    return f"{8 * wide}x{8 * high}:{bits}:{zlib.crc32(thumb.tobytes()):08x}"


def payload_of(head: Header, coefs: np.ndarray) -> bytes:
    """The bytes that `encode_many` stored."""
    flat = coefs.ravel()
    return np.where(flat < 0, flat + 255, flat).astype(np.uint8).tobytes()[: int(head.comment[8:])]


def to_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        data, offs = text_buffer(batch.column("text"))
        raw, size = data.tobytes(), np.diff(offs)
        padded = np.maximum(-(-size // BLOCK), 1) * BLOCK
        payloads = [raw[a : a + n].ljust(p, b"\0") for a, n, p in zip(offs[:-1].tolist(), size.tolist(), padded.tolist(), strict=True)]
        yield pa.record_batch([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(encode_many(payloads), pa.binary())], ["doc_id", "n_bytes", "media"])


def read_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        images = batch.column("media").to_pylist()
        while at < len(images):
            to, held = at, 0
            while to < len(images) and (to == at or held + len(images[to]) < 1 << 20):
                held += len(images[to])
                to += 1
            rows = []
            for image, (head, coefs) in zip(images[at:to], decode_many(images[at:to]), strict=True):
                stored = payload_of(head, coefs)
                thumb = thumbnail(head, coefs)
                rows.append((len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-BLOCK:]), len(image), hashlib.sha256(image).hexdigest(), feature(thumb), head.width, head.height))
            part = batch.slice(at, to - at)
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=_READ)
            at = to


_READ = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text's bytes as a baseline JPEG."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(to_media, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Decode a `media` column: sizes, hashes, dimensions and the thumbnail feature."""
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read_media, kinds)
