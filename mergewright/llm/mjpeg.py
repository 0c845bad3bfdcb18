"""Media columns: motion-JPEG in AVI, with timed clip rows by shot detection.

Writing: a payload's bytes are 8-bit samples; each becomes one flat 8x8 block of a grey baseline JPEG. With a DC quantiser
of 8 a flat block of value v has the quantised DC v - 128 and no AC, so JPEG keeps it exactly. A frame has 16 x 12 blocks
(192 samples), an AVI file one frame after another with an idx1 index. The frames' Huffman tables give a difference of s
bits a code of 15 - s bits, and the end of block one bit: each block then takes 16 bits, and whole files are coded and
decoded as numpy arrays. They are ordinary tables that each frame carries, so any baseline decoder reads the files.

Reading: the RIFF chunks are parsed, frames are found by idx1 (or by walking the movi list where there is none), and
every frame is decoded on its own. Frames with other tables or components, as cameras make them, take the general
decoder, which reads them block by block. A frame is seen as its image of block means. Shots: the difference of grey
histograms of neighbouring frames, a cut where it exceeds a floor and the mean plus DEVIATIONS standard deviations of the
differences around it. Clips are the runs between cuts, with times.

Cases: a null or empty text is a payload of one frame of spaces; payloads of any length are one file each (below 4 GB,
the format's bound); repeated rows give equal files; an empty table gives none; only the key columns asked for are
carried, and one that clashes with a result is refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

COLUMNS, LINES = 16, 12
SAMPLES = COLUMNS * LINES
RATE = 25
BINS, AROUND, DEVIATIONS, FLOOR = 16, 12, 2.0, 0.2
#: Coefficients in the order in which JPEG stores a block (fixed by the format).
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=8)
def frame_head(columns: int = COLUMNS, lines: int = LINES) -> bytes:
    """Everything of a frame before its blocks: quantisers, size, tables, scan."""
    dc_lengths = [0] * 6 + [1] * 9 + [0]  # one code of each length from 7 (for 8 bits) to 15 (for none)
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, bytes([0, 8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * lines, 8 * columns, 1, 1, 0x11, 0)),
        _segment(0xC4, bytes([0x00, *dc_lengths, *range(8, -1, -1)])),
        _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0])),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ))


def huffman(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """Symbols by (length, code) of a table as it stands in a frame."""
    out, code, at = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=8)
def block_words(dc: tuple, ac: tuple) -> tuple[np.ndarray, np.ndarray] | None:
    """For tables by which every block without AC takes 16 bits: the word of each difference (from -255), and back."""
    codes, ends = huffman(*dc), huffman(*ac)
    if ends != {(1, 0): 0} or any(n + s != 15 for (n, _), s in codes.items()):
        return None
    words, back = np.zeros(511, np.uint16), np.full(1 << 16, 1 << 14, np.int16)
    for (n, code), s in codes.items():
        for bits in range(1 << s):
            diff = bits if s == 0 or bits >> (s - 1) else bits - (1 << s) + 1
            word = (code << s | bits) << 1
            back[word] = diff
            if -255 <= diff <= 255:
                words[diff + 255] = word
    return words, back


def _own_words() -> tuple[np.ndarray, np.ndarray]:
    return block_words(*_tables(frame_head())[:2])


@lru_cache(maxsize=64)
def _tables(head: bytes):
    info = parse_head(head)
    c = info["scan"][0]
    return info["huffman"][0, c[1]], info["huffman"][1, c[2]], info


def parse_head(data: bytes) -> dict:
    """Size, components, quantisers, tables and the place of the first block of a frame."""
    info: dict = {"quant": {}, "huffman": {}, "restart": 0}
    at = 2
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            p = 0
            while p < len(body):
                wide = body[p] >> 4
                info["quant"][body[p] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, p + 1).astype(np.int64)
                p += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            p = 0
            while p < len(body):
                lengths = body[p + 1 : p + 17]
                total = sum(lengths)
                info["huffman"][body[p] >> 4, body[p] & 15] = (lengths, body[p + 17 : p + 17 + total])
                p += 17 + total
        elif marker in (0xC0, 0xC1):
            _, info["height"], info["width"], count = struct.unpack_from(">BHHB", body)
            info["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
        elif marker == 0xDD:
            info["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            info["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            info["start"] = at
            return info
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline frames can be decoded")


def coefficients(data: bytes) -> tuple[np.ndarray, dict]:
    """Dequantised blocks of a frame's first component (lines, columns, 64 in zigzag order), read bit by bit."""
    info = parse_head(data)
    body = data[info["start"] : data.rindex(b"\xff\xd9")]
    for i in range(8):
        body = body.replace(bytes([0xFF, 0xD0 + i]), b"\xff\xfe") if info["restart"] else body
    parts = [p.replace(b"\xff\x00", b"\xff") for p in (body.split(b"\xff\xfe") if info["restart"] else [body])]
    top_h, top_v = max(p[1] for p in info["parts"]), max(p[2] for p in info["parts"])
    across, down = -(-info["width"] // (8 * top_h)), -(-info["height"] // (8 * top_v))
    if len(info["parts"]) == 1:
        info["parts"] = [(info["parts"][0][0], 1, 1, info["parts"][0][3])]
        across, down = -(-info["width"] // 8), -(-info["height"] // 8)
    first = info["parts"][0]
    out = np.zeros((down * first[2], across * first[1], 64), np.int64)
    tables = {c: (huffman(*info["huffman"][0, d]), huffman(*info["huffman"][1, a])) for c, d, a in info["scan"]}
    mcu, per = 0, info["restart"] or across * down
    for part in parts:
        bits, at, seen = "".join(f"{x:08b}" for x in part), 0, dict.fromkeys(tables, 0)

        def symbol(table: dict) -> int:
            nonlocal at
            code = n = 0
            while (n, code) not in table:
                code, n, at = code << 1 | (bits[at] == "1"), n + 1, at + 1
                if n > 16:
                    raise ValueError("broken frame")
            return table[n, code]

        def number(s: int) -> int:
            nonlocal at
            v = int(bits[at : at + s] or "0", 2)
            at += s
            return v if s == 0 or v >> (s - 1) else v - (1 << s) + 1

        for _ in range(min(per, across * down - mcu)):
            for c, h, v, q in info["parts"]:
                for y in range(v):
                    for x in range(h):
                        block = np.zeros(64, np.int64)
                        seen[c] += number(symbol(tables[c][0]))
                        block[0], k = seen[c], 1
                        while k < 64 and (s := symbol(tables[c][1])) != 0:
                            k += s >> 4
                            if s & 15:
                                block[k] = number(s & 15)
                            k += 1
                        if c == first[0]:
                            out[mcu // across * v + y, mcu % across * h + x] = block * info["quant"][q]
            mcu += 1
    return out, info


def plane(data: bytes) -> np.ndarray:
    """The grey (luma) pixels of a frame, by the inverse cosine transform of its blocks."""
    blocks, info = coefficients(data)
    square = np.zeros((*blocks.shape[:2], 64))
    square[..., ZIGZAG] = blocks
    k = np.arange(8)
    basis = np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    pixels = np.einsum("uy,abuv,vx->aybx", basis, square.reshape(*blocks.shape[:2], 8, 8), basis)
    return np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).reshape(blocks.shape[0] * 8, -1)[: info["height"], : info["width"]]


def means(data: bytes) -> np.ndarray:
    """The image of block means of any baseline frame."""
    return np.clip(np.rint(coefficients(data)[0][..., 0] / 8 + 128), 0, 255).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload, a multiple of SAMPLES bytes."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16).reshape(-1, SAMPLES)
    words = _own_words()[0][np.diff(x - 128, axis=1, prepend=0) + 255].astype(">u2")
    head, frames, index, at = frame_head(), [], [], 4
    for body in map(bytes, words):
        frame = head + body.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
        chunk = _chunk(b"00dc", frame)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        frames.append(chunk)
        at += len(chunk)
    n, most = len(x), max(map(len, frames))
    width, height = 8 * COLUMNS, 8 * LINES
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"movi" + b"".join(frames)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The video frames of an AVI file, and how many there are a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movi, index, step = None, None, 0
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]  # a file may be cut off
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                kind = data[at + 8 : at + 12]
                if kind == b"movi":
                    movi = (at + 8, at + 8 + n)
                else:
                    todo.append((at + 12, at + 8 + n))
            elif name == b"avih":
                step = struct.unpack_from("<I", data, at + 8)[0]
            elif name == b"idx1":
                index = (at + 8, n // 16)
            at += 8 + n + (n & 1)
    if movi is None:
        raise ValueError("no frames")
    spans = []
    if index:
        table = np.frombuffer(data, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], index[1], index[0])
        table = table[np.char.endswith(table["id"], b"dc") | np.char.endswith(table["id"], b"db")]
        # Offsets count from the list's kind, or in some files from the file's start.
        base = movi[0] if len(table) and int(table["at"][0]) < movi[0] else 0
        spans = [(base + a + 8, base + a + 8 + n) for a, n in zip(table["at"].tolist(), table["size"].tolist(), strict=True)]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            n = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                spans.append((at + 8, at + 8 + n))
            at += 8 + n + (n & 1)
    return [data[a:b] for a, b in spans], 1_000_000 / step if step else float(RATE)


def frame_means(frames: list[bytes]) -> list[np.ndarray]:
    """Each frame's image of block means; frames with 16-bit blocks are decoded together."""
    own = frame_head()
    if frames and all(f.startswith(own) and f.endswith(b"\xff\xd9") for f in frames):
        raw = b"".join(f[len(own) : -2].replace(b"\xff\x00", b"\xff") for f in frames)
        diffs = _own_words()[1][np.frombuffer(raw, ">u2").reshape(len(frames), SAMPLES)]
        if diffs.max() < 1 << 14:
            return list((np.cumsum(diffs, 1, dtype=np.int32) + 128).astype(np.uint8).reshape(-1, LINES, COLUMNS))
    return [means(f) for f in frames]


def cuts(images: list[np.ndarray]) -> list[int]:
    """The frames with which a new shot begins."""
    n = len(images)
    if n < 2:
        return []
    sizes = np.array([i.size for i in images])
    owner = np.repeat(np.arange(n), sizes)
    bins = np.concatenate([i.ravel() for i in images]).astype(np.int64) * BINS >> 8
    hist = np.bincount(owner * BINS + bins, minlength=n * BINS).reshape(n, BINS) / sizes[:, None]
    d = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    one, two = (np.r_[0, np.cumsum(x)] for x in (d, d * d))
    at = np.arange(len(d))
    lo, hi = np.maximum(at - AROUND, 0), np.minimum(at + AROUND + 1, len(d))
    count = np.maximum(hi - lo - 1, 1)
    mean = (one[hi] - one[lo] - d) / count
    deviation = np.sqrt(np.maximum((two[hi] - two[lo] - d * d) / count - mean * mean, 0))
    return (np.flatnonzero(d > np.maximum(FLOOR, mean + DEVIATIONS * deviation)) + 1).tolist()


def padded(text: str) -> bytes:
    raw = text.encode()
    return raw + b" " * (-len(raw) % SAMPLES or (0 if raw else SAMPLES))


def _schema(df: DataFrame, keys: list[str], *results: tuple[str, T.DataType]) -> T.StructType:
    if clash := {r for r, _ in results} & set(keys):
        raise ValueError(f"key columns clash with results: {sorted(clash)}")
    return T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, t) for n, t in results)])


def store(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns, n_bytes (of the text) and media: an AVI file with the text's bytes, filled up with spaces."""
    schema, n = _schema(df, keys, ("n_bytes", T.LongType()), ("media", T.BinaryType())), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, "__text", 2 << 20):
            source = common.texts(b.column(n))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([len(t.encode()) for t in source], pa.int64()), pa.array([write_avi(padded(t)) for t in source], pa.binary())], names=schema.names)

    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)


def read(df: DataFrame, keys: list[str], media: str = "media") -> DataFrame:
    """The key columns, payload (the samples of all frames), frames, rate and cuts of each AVI file; null media give null."""
    schema, n = _schema(df, keys, ("payload", T.BinaryType()), ("frames", T.LongType()), ("rate", T.DoubleType()), ("cuts", T.ArrayType(T.LongType()))), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, "__media", 8 << 20):
            rows = []
            for data in b.column(n).to_pylist():
                if data is None:
                    rows.append((None, None, None, None))
                    continue
                frames, rate = read_avi(data)
                images = frame_means(frames)
                rows.append((b"".join(i.tobytes() for i in images), len(frames), rate, cuts(images)))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.float64(), pa.list_(pa.int64())), strict=True))], names=schema.names)

    return df.select(*keys, F.col(media).alias("__media")).mapInArrow(run, schema)


def clips(read_back: DataFrame, keys: list[str]) -> DataFrame:
    """A row per clip of what read() returns: the key columns, clip, first_frame, end_frame, start_ms and end_ms."""
    bounds = F.concat(F.array(F.lit(0).cast("long")), "cuts", F.array("frames"))
    rows = read_back.where("frames > 0").select(*keys, "rate", bounds.alias("__bounds"))
    rows = rows.select(*keys, "rate", "__bounds", F.explode(F.expr("sequence(1, size(__bounds) - 1)")).alias("clip"))
    first, end = F.element_at("__bounds", F.col("clip")), F.element_at("__bounds", F.col("clip") + 1)
    ms = lambda c: F.round(c * 1000 / F.col("rate")).cast("long")
    return rows.select(*keys, "clip", first.alias("first_frame"), end.alias("end_frame"), ms(first).alias("start_ms"), ms(end).alias("end_ms"))
