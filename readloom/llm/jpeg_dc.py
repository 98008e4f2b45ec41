"""Baseline JPEG media columns: DC-only luminance thumbnails, dimensions and thumbnail hashes.

Reading parses markers, decodes the Huffman-coded scans and rebuilds one luminance pixel for each
8 x 8 block from its DC coefficient. All restart intervals of all images with the same tables are
decoded in step with each other, one block of each at a time, as numpy vectors.

Writing stores bytes without loss as quantised DC coefficients, the unit of this format: one block
for each byte, 192 blocks to a restart interval, no AC coefficients. With a DC quantiser of 8 the
thumbnail's pixels are the bytes. A comment holds their number. An image takes up to 8,191 rows;
longer payloads get wider images, and beyond 66 MB further images after the first.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import sliced

UNIT, SIDE = 192, 8191
WIDEST = SIDE // UNIT * UNIT
#: Own Huffman tables: how many codes of each length 1..16, and the symbols in order of code.
DC_BITS, DC_SYMBOLS = [0, 2, 1, 3, 2, 4, *[0] * 10], [4, 7, 3, 0, 1, 5, 2, 6, 8, 9, 10, 11]
AC_BITS, AC_SYMBOLS = [1, *[0] * 15], [0]
FRAME = WIDEST * SIDE
#: Pixels that are coded or decoded at a time.
AT_ONCE = 1 << 20


def codes(bits: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table as its marker gives it."""
    out, code, at = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(bits: list[int], symbols: list[int]) -> np.ndarray:
    """For 16 coming bits: length << 8 | symbol, 0 where no code fits."""
    table = np.zeros(1 << 16, np.uint16)
    for symbol, code, length in codes(bits, symbols):
        table[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return table


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


QUANT = segment(0xDB, bytes([0, 8, *[1] * 63]))
TABLES = segment(0xC4, bytes([0x00, *DC_BITS, *DC_SYMBOLS])) + segment(0xC4, bytes([0x10, *AC_BITS, *AC_SYMBOLS]))
RESTART, SCAN = segment(0xDD, struct.pack(">H", UNIT)), segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def block_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each difference of two bytes, from -255: the bits of a whole block, and how many they are."""
    dc, ac = {s: (c, n) for s, c, n in codes(DC_BITS, DC_SYMBOLS)}, {s: (c, n) for s, c, n in codes(AC_BITS, AC_SYMBOLS)}
    bits, size = [], []
    for d in range(-255, 256):
        k = abs(d).bit_length()
        code, n = dc[k]
        code, n = code << k | (d if d > 0 else d + (1 << k) - 1), n + k
        bits.append(code << ac[0][1] | ac[0][0])
        size.append(n + ac[0][1])
    return np.array(bits, np.uint64), np.array(size, np.uint64)


BLOCK_BITS, BLOCK_SIZE = block_codes()


def entropy(rows: np.ndarray, ends: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded restart intervals, one for each row of bytes, each with the marker that follows: the end of
    the image where `ends`, else restart number `turn`. Gives all bytes and the length of each row's."""
    n, (u64, big) = len(rows), (np.uint64, np.uint64(64))
    diff = np.diff(rows.astype(np.int16), axis=1, prepend=np.int16(128)) + np.int16(255)
    bits, size = BLOCK_BITS[diff], BLOCK_SIZE[diff]
    code, length = bits[:, ::3], size[:, ::3]  # three blocks are at most 54 bits
    for k in (1, 2):
        code, length = code << size[:, k::3] | bits[:, k::3], length + size[:, k::3]
    total = length.sum(1, dtype=u64)
    pad = (u64(8) - total % u64(8)) % u64(8)
    code = np.concatenate([code, ((u64(1) << pad) - u64(1))[:, None]], axis=1)
    length = np.concatenate([length, pad[:, None]], axis=1)
    at = np.cumsum(length, axis=1, dtype=u64) - length
    words = int((total.max() + u64(7)) // u64(64)) + 2
    place = (np.arange(n, dtype=u64) * u64(words))[:, None] + (at >> u64(6))
    offset = at & u64(63)
    # Left-aligned in 128 bits at the offset: the part in this word, and in the next.
    wide = np.where(length > 0, code << (big - np.maximum(length, u64(1))), u64(0))
    high, low = wide >> offset, np.where(offset > 0, wide << (big - np.maximum(offset, u64(1))), u64(0))
    out = np.zeros(n * words, u64)
    flat = place.ravel().astype(np.int64)
    first = np.flatnonzero(np.diff(flat, prepend=-1))
    out[flat[first]] |= np.bitwise_or.reduceat(high.ravel(), first)
    out[flat[first] + 1] |= np.bitwise_or.reduceat(low.ravel(), first)
    n_bytes = ((total + pad) >> u64(3)).astype(np.int64)
    grid = out.astype(">u8").view(np.uint8).reshape(n, words * 8)
    raw = grid[np.arange(words * 8)[None, :] < n_bytes[:, None]]
    full = raw == 255
    stuffed = np.repeat(raw, 1 + full)
    stuffed[np.flatnonzero(full) + np.cumsum(full)[full]] = 0
    n_bytes = n_bytes + np.add.reduceat(full, np.cumsum(n_bytes) - n_bytes, dtype=np.int64)
    ends_at = np.cumsum(n_bytes + 2)
    done = np.empty(ends_at[-1], np.uint8)
    mark = np.zeros(len(done), bool)
    mark[ends_at - 1] = mark[ends_at - 2] = True
    done[~mark] = stuffed
    done[ends_at - 2], done[ends_at - 1] = 255, np.where(ends, 0xD9, 0xD0 + turn)
    return done, n_bytes + 2


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """JPEG files that hold the payloads, each of a positive multiple of 192 bytes."""
    frames = [(i, p[k : k + FRAME]) for i, p in enumerate(payloads) for k in range(0, len(p), FRAME)]
    heads, pieces, shapes = [], [], []
    for _, p in frames:
        units = len(p) // UNIT
        across = -(-units // SIDE)
        down = -(-units // across)
        heads.append(b"\xff\xd8" + segment(0xFE, b"%d" % len(p)) + QUANT + segment(0xC0, struct.pack(">BHHBBBB", 8, down * 8, across * UNIT * 8, 1, 1, 0x11, 0)) + TABLES + RESTART + SCAN)
        pieces.append(p.ljust(down * across * UNIT, b" "))
        shapes.append(down * across)
    n = np.array(shapes, np.int64)
    stop = np.cumsum(n)
    ends = np.zeros(stop[-1], bool)
    ends[stop - 1] = True
    turn = (np.arange(stop[-1]) - np.repeat(stop - n, n)) % 8
    rows, step = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, UNIT), AT_ONCE // UNIT
    coded = [entropy(rows[k : k + step], ends[k : k + step], turn[k : k + step]) for k in range(0, len(rows), step)]
    edge = np.concatenate([[0], np.cumsum(np.concatenate([size for _, size in coded]))[stop - 1]])
    out = [b""] * len(payloads)
    data = b"".join([part.data for part, _ in coded])
    for (i, _), head, a, b in zip(frames, heads, edge[:-1].tolist(), edge[1:].tolist()):
        out[i] += head + data[a:b]
    return out


class Image:
    """One image of a file as its markers describe it."""

    def __init__(self):
        self.quant, self.huff, self.restart, self.comment = {}, {}, 0, b""
        self.width = self.height = 0
        self.components: list[tuple[int, int, int, int]] = []  # id, across, down, quantiser
        self.scan: list[tuple[int, int, int]] = []  # component number, DC table, AC table
        self.begin = self.end = 0


def parse(data: bytes) -> list[Image]:
    """The images of a file, one after the other, for baseline files of 8-bit samples."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        im, at = Image(), at + 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) or data[at] != 255:
                raise ValueError("no marker where one is due")
            marker, size = data[at + 1], data[at + 2] << 8 | data[at + 3]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    im.quant[body[k] & 15] = body[k + 1] << 8 | body[k + 2] if wide else body[k + 1]
                    k += 1 + 64 * (1 + bool(wide))
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1 : k + 17])
                    im.huff[body[k]] = bytes(body[k + 1 : k + 17 + n])
                    k += 17 + n
            elif marker in (0xC0, 0xC1):
                depth, im.height, im.width, n = struct.unpack(">BHHB", body[:6])
                if depth != 8 or not im.width or not im.height:
                    raise ValueError("not 8-bit samples, or no size")
                im.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
            elif marker == 0xDD:
                im.restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xFE:
                im.comment = body
            elif marker == 0xDA:
                known = {c[0]: k for k, c in enumerate(im.components)}
                im.scan = [(known[body[k]], body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)]
                break
            elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0), 0xD9):
                raise ValueError("not a baseline image")
        if im.scan[0][0] or len(im.scan) not in (1, len(im.components)):
            raise ValueError("the first scan has no luminance")
        im.begin = at
        while True:  # the scan's end: a marker that isn't a restart
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                raise ValueError("the scan doesn't end")
            if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                at += 2
            else:
                break
        im.end = at
        at = data.find(b"\xff\xd9", at)  # further scans have no luminance
        if at < 0:
            raise ValueError("no end of image")
        at += 2
        out.append(im)
    if not out:
        raise ValueError("empty file")
    return out


def intervals(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All restart intervals of scans that each end with a marker: bytes without stuffing, then each
    interval's start, its length, and the number of intervals of each scan."""
    raw = np.frombuffer(b"".join(scans), np.uint8)
    full = np.flatnonzero(raw[:-1] == 255)
    after = raw[full + 1]
    marks, zeros = full[after != 0], full[after == 0] + 1
    keep = np.ones(len(raw), bool)
    keep[zeros] = keep[marks] = keep[marks + 1] = False
    data = raw[keep]
    upto = marks - np.searchsorted(zeros, marks) - 2 * np.arange(len(marks))  # where an interval ends in data
    start = np.concatenate([[0], upto[:-1]])
    per = np.diff(np.searchsorted(marks, np.cumsum([len(s) for s in scans])), prepend=0)
    return data, start, upto - start, per


def decode_dc(data: np.ndarray, start: np.ndarray, length: np.ndarray, blocks: np.ndarray, plan: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """DC coefficients of component 0, one row for each interval, and whether an interval is whole.
    blocks: MCUs of each interval. plan: for each block of an MCU its component and tables."""
    u64, n = np.uint64, len(start)
    padded = np.concatenate([data, np.full(16, 255, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    windows = np.ascontiguousarray(windows).view(">u8").ravel().astype(u64)
    at, last = start.astype(np.int64) * 8, (start + length).astype(np.int64) * 8
    ones = sum(c == 0 for c, _, _ in plan)
    out = np.zeros((int(blocks.max()) * ones, n), np.int16)
    before = {c: np.zeros(n, np.int64) for c, _, _ in plan}
    good, step = np.ones(n, bool), 0
    order = np.argsort(-blocks, kind="stable")  # those that still have blocks come first
    at, last, blocks = at[order], last[order], blocks[order]
    limit = len(windows) - 1
    for mcu in range(int(blocks[0])):
        m = int(np.searchsorted(-blocks, -mcu, side="left"))  # intervals with more than mcu blocks
        a, ok = at[:m], good[:m]
        for c, dc, ac in plan:
            w = windows[np.minimum(a >> 3, limit)] << (a & 7).astype(u64)
            got = dc[(w >> u64(48)).astype(np.int64)]
            size, k = (got >> 8).astype(np.int64), (got & 15).astype(np.int64)
            ok &= size > 0
            value = (w << size.astype(u64) >> u64(48)).astype(np.int64) >> (16 - k)
            value += np.where((k > 0) & (value < (1 << k >> 1)), 1 - (1 << k), 0)
            before[c][:m] += value
            used = size + k
            got = ac[(w << used.astype(u64) >> u64(48)).astype(np.int64)]
            a += used + (got >> 8)
            ok &= got > 0
            if c == 0:
                out[step, :m] = before[0][:m]
                step += 1
            left = np.flatnonzero((got & 255) != 0)  # blocks with AC coefficients, which are passed over
            done = np.zeros(len(left), np.int64)
            got = got[left]
            while len(left):
                symbol = (got & 255).astype(np.int64)
                a[left] += symbol & 15
                done += (symbol >> 4) + 1
                more = (done < 63) & ((got > 0) & (symbol != 0))
                left, done = left[more], done[more]
                if len(left):
                    w = windows[np.minimum(a[left] >> 3, limit)] << (a[left] & 7).astype(u64)
                    got = ac[(w >> u64(48)).astype(np.int64)]
                    a[left] += (got >> 8).astype(np.int64)
                    ok[left] &= got > 0
                    on = (got & 255) != 0
                    left, done, got = left[on], done[on], got[on]
    good &= (at <= last) & (last - at < 8)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return out[:, back].T, good[back]


def decode_pixels(data, start, length, blocks, plan, scale) -> tuple[np.ndarray, np.ndarray]:
    """The luminance pixels of all intervals, one after the other, and whether an interval is whole; intervals of about AT_ONCE
    pixels are decoded in step. scale: each interval's DC quantiser."""
    ones = sum(c == 0 for c, _, _ in plan)
    upto = np.cumsum(blocks * ones)
    pixels, good, a = np.empty(upto[-1], np.uint8), np.empty(len(start), bool), 0
    while a < len(start):
        begin = upto[a] - blocks[a] * ones
        z = max(a + 1, int(np.searchsorted(upto, begin + AT_ONCE, side="right")))
        low, high = start[a], start[z - 1] + length[z - 1]
        dc, good[a:z] = decode_dc(data[low:high], start[a:z] - low, length[a:z], blocks[a:z], plan)
        light = np.clip((dc.astype(np.int32) * scale[a:z, None] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
        pixels[begin : upto[z - 1]] = light[np.arange(light.shape[1]) < (blocks[a:z] * ones)[:, None]]
        a = z
    return pixels, good


def read_many(files: list[bytes | None]) -> list[list[tuple[Image, np.ndarray]] | None]:
    """(image, thumbnail) for each image of each file, None for a file that can't be read."""
    parsed: list[list[Image] | None] = []
    groups = defaultdict(list)
    for i, data in enumerate(files):
        try:
            parsed.append(parse(data or b""))
        except (ValueError, IndexError, KeyError, struct.error):
            parsed.append(None)
            continue
        for j, im in enumerate(parsed[-1]):
            shape = [im.components[c] for c, _, _ in im.scan]
            alone = len(im.scan) == 1
            key = tuple(((1, 1) if alone else s[1:3], im.huff.get(d), im.huff.get(16 | a)) for s, (_, d, a) in zip(shape, im.scan))
            groups[key].append((i, j, im))
    thumbs: dict[tuple[int, int], np.ndarray] = {}
    bad: set[int] = set()
    for key, members in groups.items():
        if any(d is None or a is None for _, d, a in key):
            bad |= {i for i, _, _ in members}
            continue
        plan = [(c, lookup(list(d[:16]), list(d[16:])), lookup(list(a[:16]), list(a[16:]))) for c, ((h, v), d, a) in enumerate(key) for _ in range(h * v)]
        h0, v0 = key[0][0]
        data, start, length, per = intervals([files[i][im.begin : im.end + 2] for i, _, im in members])
        blocks, whole = [], []
        for n, (i, _, im) in zip(per.tolist(), members):
            high, wide = max(c[1] for c in im.components), max(c[2] for c in im.components)
            if len(im.scan) == 1:
                own = im.components[0]
                x, y = -(-(-(-im.width * own[1] // high)) // 8), -(-(-(-im.height * own[2] // wide)) // 8)
            else:
                x, y = -(-im.width // (8 * high)), -(-im.height // (8 * wide))
            mcus = x * y
            every = im.restart or mcus
            need = -(-mcus // every)
            whole.append((x, y, need == n))
            b = np.full(n, every, np.int64)
            if n:
                b[-1] = mcus - every * (need - 1)
            blocks.append(np.maximum(b, 1) if need == n else np.ones(n, np.int64))
        if not len(start):
            bad |= {i for i, _, _ in members}
            continue
        blocks = np.concatenate(blocks)
        scale = np.repeat([im.quant.get(im.components[0][3], 1) for _, _, im in members], per)
        pixels, good = decode_pixels(data, start, length, blocks, plan, scale)
        edge = np.concatenate([[0], np.cumsum(blocks * h0 * v0)])
        at = 0
        for n, (i, j, im), (x, y, fits) in zip(per.tolist(), members, whole):
            if not fits or not good[at : at + n].all():
                bad.add(i)
            else:
                flat = pixels[edge[at] : edge[at + n]][: x * y * h0 * v0]
                grid = flat.reshape(y, x, v0, h0).transpose(0, 2, 1, 3).reshape(y * v0, x * h0)
                thumbs[i, j] = grid[: -(-im.height // 8), : -(-im.width // 8)] if len(im.scan) > 1 or len(im.components) == 1 else grid
            at += n
    return [None if p is None or i in bad else [(im, thumbs[i, j]) for j, im in enumerate(p)] for i, p in enumerate(parsed)]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits in hexadecimal: which cells of an 8 x 8 division are brighter than the mean of the cells."""
    rows, columns = (np.arange(9) * n // 8 for n in thumb.shape)
    sums = np.add.reduceat(np.add.reduceat(thumb, rows[:8], axis=0, dtype=np.int64), columns[:8], axis=1)
    cells = sums / (np.maximum(np.diff(rows), 1)[:, None] * np.maximum(np.diff(columns), 1)[None, :])
    return np.packbits(cells > cells.mean()).tobytes().hex()


def feature(images: list[tuple[Image, np.ndarray]]) -> str:
    return ";".join(f"{im.width}x{im.height}:{thumbnail_hash(t)}" for im, t in images)


def payload_of(images: list[tuple[Image, np.ndarray]]) -> bytes:
    return b"".join(t.tobytes()[: int(im.comment)] for im, t in images)


def jpeg_columns(df: DataFrame, image_column: str = "image", id_column: str = "doc_id") -> DataFrame:
    """(id, width, height, thumbnail_hash, thumbnail, error) of the first image of each binary value.
    Null, empty and unreadable values have nulls and error true; other columns don't matter."""
    schema = f"id {df.schema[id_column].dataType.simpleString()}, width int, height int, thumbnail_hash string, thumbnail binary, error boolean"

    def run(batches):
        for batch in sliced(batches, "image"):
            got = read_many(batch.column("image").to_pylist())
            first = [g[0] if g else None for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([g and g[0].width for g in first], pa.int32()),
                    pa.array([g and g[0].height for g in first], pa.int32()),
                    pa.array([g and thumbnail_hash(g[1]) for g in first], pa.string()),
                    pa.array([g and g[1].tobytes() for g in first], pa.binary()),
                    pa.array([g is None for g in first], pa.bool_()),
                ],
                ["id", "width", "height", "thumbnail_hash", "thumbnail", "error"],
            )

    return df.select(F.col(id_column).alias("id"), F.col(image_column).alias("image")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def store_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_media: bool = False) -> DataFrame:
    """Each whole text (null: empty) as UTF-8, padded with spaces to a positive multiple of 192,
    stored as a JPEG, read back from the stored bytes, and described. Equal texts give equal values;
    repeated rows stay repeated; an empty table gives no rows; further columns of `df` don't matter, whatever their names. Long
    texts are coded and read in parts of AT_ONCE pixels. keep_media adds the stored bytes. A narrow pass without a shuffle."""
    schema = f"id {df.schema[id_column].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in sliced(batches):
            raw = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            media = encode_many([t.ljust(max(1, -(-len(t) // UNIT)) * UNIT, b" ") for t in raw])
            images = read_many(media)
            back = [payload_of(g) for g in images]
            columns = [batch.column("id"), pa.array(map(len, raw), pa.int64()), pa.array(map(len, back), pa.int64()), pa.array(map(sha, back)), pa.array([zlib.crc32(b[-16:]) for b in back], pa.int64()), pa.array(map(len, media), pa.int64()), pa.array(map(sha, media)), pa.array(map(feature, images))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(media, pa.binary())] if keep_media else columns, names)

    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)
