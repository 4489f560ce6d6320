"""Baseline JPEG in numpy: lossless payloads, Huffman decoding, DC-only thumbnails.

A payload byte is one quantised coefficient of size category 8: the eight magnitude bits
are the byte. A block holds 64 bytes in zigzag order and is a restart interval of its own,
so that the decoder walks all intervals of a batch of files side by side. The decoder reads
baseline files of grey and colour pictures: markers, tables, sampling factors, interleaved and
separate scans (of these the luminance's), restart intervals, byte stuffing. A scan must end
where its frame says.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .kernels import buffers, slices

COMMENT = b"payload "
U = np.uint64


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


#: One code of one bit for category 8; the two-bit code is a flat DC (0) or the end of block.
DC_TABLE = bytes([0x00, 1, 1, *[0] * 14, 0x08, 0x00])
AC_TABLE = bytes([0x10, 1, 1, *[0] * 14, 0x08, 0x00])
FLAT = b"\xaf"  # an empty block: both two-bit codes, filled up with ones


def encode(payload: np.ndarray) -> bytes:
    """A grey JPEG whose coefficients are the payload's bytes; its length is a positive multiple of 64."""
    n = len(payload) // 64
    wide = max(1, math.isqrt(n - 1) + 1 if n > 1 else 1)
    high = -(-n // wide)
    if high > 8191:
        raise ValueError("payload too long for one image")
    bits = np.zeros((n, 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(payload.reshape(n, 64, 1), axis=2)
    coded = np.packbits(bits.reshape(n, 576), axis=1)
    marks = np.empty((n, 74), np.uint8)
    marks[:, :72] = coded
    marks[:, 72] = 0xFF
    marks[:, 73] = 0xD0 + np.arange(n) % 8
    scan = marks.ravel()
    stuff = scan == 0xFF
    stuff[72::74] = False
    scan = np.insert(scan, np.flatnonzero(stuff) + 1, 0) if stuff.any() else scan
    rest = b"".join(FLAT + bytes([0xFF, 0xD0 + i % 8]) for i in range(n, wide * high))
    body = (scan.tobytes() + rest)[:-2]
    head = b"\xff\xd8" + segment(0xFE, COMMENT + str(len(payload)).encode()) + segment(0xDB, b"\0" + b"\1" * 64)
    head += segment(0xC0, b"\x08" + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + b"\1\1\x11\0")
    head += segment(0xC4, DC_TABLE) + segment(0xC4, AC_TABLE) + segment(0xDD, b"\0\1") + segment(0xDA, b"\1\1\0\0\x3f\0")
    return head + body + b"\xff\xd9"


@dataclass
class Image:
    """What the markers say, and where the scan's restart intervals lie."""

    width: int
    height: int
    quant: list[int]  # of the luminance
    units: tuple[tuple[int, bytes, bytes], ...]  # the blocks of an MCU: component, DC table, AC table
    sampling: tuple[int, int]  # the luminance's blocks in an MCU, across and down
    mcus: tuple[int, int]  # across and down
    interval: int
    comment: bytes
    scan: np.ndarray  # without stuffing and markers
    starts: np.ndarray


def parse(data: bytes) -> Image:
    """Raises ValueError for what is no whole baseline JPEG."""
    try:
        return markers(data)
    except (IndexError, KeyError) as e:
        raise ValueError(f"broken markers: {e}") from e


def markers(data: bytes) -> Image:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, huff, interval, comment, frame = 2, {}, {}, 0, b"", None
    while True:
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        while data[at + 1] == 0xFF:
            at += 1
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if marker == 0xD9 or size < 2 or len(body) != size - 2:
            raise ValueError("no scan of the luminance")
        at += 2 + size
        if marker == 0xDB:
            while body:
                width = 128 if body[0] >> 4 else 64
                quant[body[0] & 15], body = [int.from_bytes(body[i : i + width // 64], "big") for i in range(1, 1 + width, width // 64)], body[1 + width :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n or sum(c << (16 - i) for i, c in enumerate(body[1:17], 1)) > 1 << 16:
                    raise ValueError("broken table")
                huff[body[0]], body = body[1 : 17 + n], body[17 + n :]
        elif marker == 0xC0:
            frame = body
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            raw = np.frombuffer(data, np.uint8)[at:]
            mark = np.flatnonzero(raw[:-1] == 0xFF)
            then = raw[mark + 1]
            end = mark[(then != 0) & ((then < 0xD0) | (then > 0xD7))]
            if not len(end):
                raise ValueError("no end of the scan")
            stop = int(end[0])
            if frame is not None and frame[6] in body[1 : 1 + 2 * body[0] : 2]:
                break
            at += stop
    mark, then = mark[mark < stop], then[mark < stop]
    keep = np.ones(stop, bool)
    keep[np.minimum(mark + 1, stop - 1)[mark + 1 < stop]] = False
    restarts = mark[then != 0]
    keep[restarts] = False
    gone = np.concatenate([[0], np.cumsum(keep)])
    parts = {frame[6 + 3 * i]: (frame[7 + 3 * i] >> 4, frame[7 + 3 * i] & 15, frame[8 + 3 * i]) for i in range(frame[5])}
    first, height, width = frame[6], int.from_bytes(frame[1:3], "big"), int.from_bytes(frame[3:5], "big")
    if not (height and width and all(h and v for h, v, _ in parts.values())):
        raise ValueError("empty frame")
    most = max(h for h, _, _ in parts.values()), max(v for _, v, _ in parts.values())
    own, units = parts[first], []
    if body[0] == 1:  # a scan of one component has its blocks in order
        across, down = (-(-(-(-x * o // m)) // 8) for x, o, m in zip((width, height), own, most))
        sampling = (1, 1)
    else:
        across, down = (-(-x // (8 * m)) for x, m in zip((width, height), most))
        sampling = own[:2]
    for i in range(body[0]):
        name, ids = body[1 + 2 * i], body[2 + 2 * i]
        h, v, _ = parts[name]
        units += [(i, huff[ids >> 4], huff[0x10 | ids & 15])] * (1 if body[0] == 1 else h * v)
    if body[1] != first:
        raise ValueError("luminance is not the scan's first component")
    image = Image(width, height, quant[own[2]], tuple(units), sampling, (across, down), interval, comment, raw[:stop][keep], np.concatenate([[0], gone[restarts]]))
    if len(image.starts) != (-(-across * down // interval) if interval else 1):
        raise ValueError("broken scan: restart intervals are missing")
    return image


def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: code length | run << 8 | size << 16; length 0 where no code fits."""
    out, code, at = np.zeros(65536, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            lo = code << (16 - length)
            out[lo : lo + (1 << (16 - length))] = length | (table[at] >> 4) << 8 | (table[at] & 15) << 16
            code += 1
            at += 1
        code <<= 1
    return out


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """The luminance's 64 quantised coefficients a block, in zigzag order, MCU by MCU, of images that share tables, sampling and interval."""
    units = images[0].units
    tables = {t: lookup(t) for u in units for t in u[1:]}
    lead = images[0].sampling[0] * images[0].sampling[1]
    each = [i.mcus[0] * i.mcus[1] for i in images]
    data = np.concatenate([*(i.scan for i in images), np.zeros(16, np.uint8)])
    base = np.cumsum([0, *(len(i.scan) for i in images)])
    bit = np.concatenate([(i.starts + b) * 8 for i, b in zip(images, base)])
    ends = np.concatenate([np.append(i.starts[1:], len(i.scan)) + b for i, b in zip(images, base)])
    view = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    interval = images[0].interval or max(each)
    mcus = np.concatenate([np.minimum(interval, n - interval * np.arange(len(i.starts))) for i, n in zip(images, each)])
    first = np.concatenate([b + interval * np.arange(len(i.starts)) for i, b in zip(images, np.cumsum([0, *each])[:-1])])
    out = np.zeros((sum(each) * lead, 64), np.int16)
    previous = np.zeros((1 + max(u[0] for u in units), len(bit)), np.int64)

    def step(table: np.ndarray, who) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = bit[who]
        window = view[np.minimum(b >> 3, len(view) - 1)].astype(np.uint64) << (b & 7).astype(np.uint64)
        entry = table[(window >> U(48)).astype(np.int64)]
        length, run, size = entry & 255, entry >> 8 & 255, entry >> 16
        if not length.all():
            raise ValueError("broken scan")
        s = size.astype(np.uint64)
        value = ((window << length.astype(np.uint64)) >> U(1) >> (U(63) - s)).astype(np.int64)
        value += np.where(value < (np.int64(1) << np.maximum(size - 1, 0)), 1 - (np.int64(1) << size), 0)
        bit[who] = b + length + size
        return run, size, np.where(size > 0, value, 0)

    for m in range(int(mcus.max(initial=0))):
        every = np.flatnonzero(mcus > m)
        for u, (part, dc, ac) in enumerate(units):
            live = every
            _, _, value = step(tables[dc], live)
            previous[part, live] += value
            row = (first[live] + m) * lead + u
            if u < lead:
                out[row, 0] = previous[0, live]
            k = np.ones(len(live), np.int64)
            while len(live):
                run, size, value = step(tables[ac], live)
                at = k + run
                if (at > 63)[size > 0].any():
                    raise ValueError("broken scan")
                some = size > 0
                if u < lead:
                    if some.all():
                        out[row, at] = value
                    else:
                        out[row[some], at[some]] = value[some]
                k = at + 1
                go = (k < 64) & (some | (run == 15))
                if not go.all():
                    live, row, k = live[go], row[go], k[go]
    if ((bit + 7) // 8 != ends).any():
        raise ValueError("broken scan: it does not end where its frame says")
    return np.split(out, np.cumsum([n * lead for n in each])[:-1])


def decode(files: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """Each file's markers and luminance blocks; raises ValueError if one is damaged."""
    images = [parse(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        groups.setdefault((x.units, x.sampling, x.interval), []).append(i)
    out: list = [None] * len(files)
    for rows in groups.values():
        for i, c in zip(rows, coefficients([images[i] for i in rows])):
            out[i] = (images[i], c)
    return out


def decoded(files: list[bytes]) -> list[tuple[Image, np.ndarray] | ValueError]:
    """decode(), with the error in place of what is damaged."""
    try:
        return decode(files)
    except ValueError as e:
        if len(files) == 1:
            return [e]
        half = len(files) // 2
        return decoded(files[:half]) + decoded(files[half:])


def payload(image: Image, blocks: np.ndarray) -> bytes | None:
    """The bytes that encode() stored; null for other pictures."""
    said = image.comment[len(COMMENT) :]
    if not image.comment.startswith(COMMENT) or not said.isdigit() or int(said) > blocks.size:
        return None
    v = blocks.reshape(-1)[: int(said)]
    return np.where(v > 0, v, v + 255).astype(np.uint8).tobytes()


def thumbnail(image: Image, blocks: np.ndarray) -> np.ndarray:
    """Luminance from the DC coefficients alone: a pixel for each 8 x 8 block, in whole MCUs."""
    grey = np.clip(np.rint(blocks[:, 0].astype(np.float64) * image.quant[0] / 8 + 128), 0, 255).astype(np.uint8)
    (across, down), (h, v) = image.mcus, image.sampling
    return grey.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)


def feature(image: Image, blocks: np.ndarray) -> str:
    """width x height : 64-bit average hash of the thumbnail : its digest."""
    small = thumbnail(image, blocks)
    rows, cols = (np.linspace(0, s, 9).astype(int)[:-1] for s in small.shape)
    cells = small[np.minimum(rows, small.shape[0] - 1)][:, np.minimum(cols, small.shape[1] - 1)]
    average = np.packbits(cells.ravel() > cells.mean()).tobytes().hex()
    return f"{image.width}x{image.height}:{average}:{hashlib.md5(small.tobytes()).hexdigest()}"


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, filled up with zeros to a positive multiple of 64, as a JPEG.

    Edge cases: null and empty texts make one block; a null doc_id stays null; repeated rows
    are stored each; an empty table gives no rows; further columns are ignored. A payload
    ends at 8191 blocks squared (4.2 GB), beyond Spark's largest value.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for batch in slices(batches, "text", 1 << 19):
            raw, off = buffers(batch.column("text"))
            media = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                held = np.zeros(max(64, -(-(b - a) // 64) * 64), np.uint8)
                held[: b - a] = raw[a:b]
                media.append(encode(held))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(media, pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """media's rows with payload, width, height, thumbnail, feature and error, read back from the stored bytes.

    What is damaged (cut, with a broken table or scan) or no baseline JPEG has an error and
    else nulls; whole pictures that store_media did not write have no payload. Null media
    stay null, without an error.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("width", pa.int64()), ("height", pa.int64()), ("thumbnail", pa.binary()), ("feature", pa.string()), ("error", pa.string())]
    schema = pa.schema(fields)

    def run(batches):
        for batch in slices(batches, "media", 1 << 19):
            files = batch.column("media").to_pylist()
            some = [f for f in files if f is not None]
            got = iter(decoded(some) if some else [])
            rows = [None if f is None else next(got) for f in files]
            fine = [None if isinstance(r, ValueError) else r for r in rows]
            facts = [
                [r and payload(*r) for r in fine],
                [r and r[0].width for r in fine],
                [r and r[0].height for r in fine],
                [r and thumbnail(*r).tobytes() for r in fine],
                [r and feature(*r) for r in fine],
                [str(r) if isinstance(r, ValueError) else None for r in rows],
            ]
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "n_bytes", "media"]).columns, *(pa.array(f, t) for f, (_, t) in zip(facts, fields[3:]))], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, width long, height long, thumbnail binary, feature string, error string")


def media_digests(docs: DataFrame) -> DataFrame:
    """The digests of what store_media stores and read_media reads back."""
    read = read_media(store_media(docs))
    tail = F.expr("substring(payload, -64, 64)")
    return read.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")
