"""GIF: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

``encode`` stores bytes losslessly as the pixels of coloured frames 64 wide, of 64 KB each; ``decode`` reads any GIF of the two
published versions: global and local palettes, interlacing, transparency, the four disposal methods and
delays. ``frame_rows`` turns a table of GIF files into a row per timed frame.

A null text is an empty one: one row of 64 zero samples. Null or damaged files give no frames in ``frame_rows``
(with ``errors="null"``, one row with the message). Repeated rows and ties are rows of their own with equal values; an empty table gives no rows; very long texts take
more frames. Other columns are not read, so their names may be any.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandweave.llm.frames import lean, load, schema
from strandweave.llm.textscan import slices, text_of

WIDTH = 64
MAX_ROWS = 1024
DELAY_CS = 10
BINS = 4


@dataclass
class Frame:
    """One frame: its own pixels as palette indices, and the canvas after drawing it."""

    left: int
    top: int
    indices: np.ndarray
    start_ms: int
    delay_ms: int
    disposal: int
    transparent: int | None
    histogram: list[int]
    canvas: np.ndarray | None


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of samples of ``bits`` bits, without block bounds."""
    clear = 1 << bits
    codes, lengths = [], []
    at = 0
    while True:  # one run of the table at a time, so that widths follow from the place in the run
        table: dict[int, int] = {}
        run = [clear]
        new = clear + 2
        add, get = run.append, table.get
        if at < len(data):
            cur = data[at]
            at += 1
            for b in memoryview(data)[at:]:
                at += 1
                k = cur << 8 | b
                c = get(k)
                if c is not None:
                    cur = c
                    continue
                add(cur)
                cur = b
                table[k] = new
                new += 1
                if new == 4096:
                    at -= 1
                    break
            else:
                add(cur)
        lengths.append(len(run))
        codes += run
        if at >= len(data):
            break
    codes.append(clear + 1)
    lengths[-1] += 1
    widths = np.concatenate([_write_widths(n, bits) for n in lengths])
    return _pack(np.array(codes, np.int64), widths)


def _write_widths(n: int, bits: int) -> np.ndarray:
    """Widths of a clear code, in the width at the end of the run before it, and of the codes after it."""
    i = np.arange(n - 1)
    w = np.maximum(np.ceil(np.log2(np.maximum(i, 0) + (1 << bits) + 2)).astype(np.int64), bits + 1)
    return np.concatenate(([-1], np.minimum(w, 12)))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    cleared = np.flatnonzero(widths < 0)
    widths[cleared[1:]] = 12
    widths[cleared[0]] = widths[1]
    ends = np.cumsum(widths)
    begins = ends - widths
    value = codes << (begins & 7)
    byte = begins >> 3
    out = np.zeros(int(ends[-1] + 7) // 8 + 3)
    for k in range(3):
        out += np.bincount(byte + k, (value >> (8 * k)) & 255, len(out))
    return out.astype(np.uint8)[: int(ends[-1] + 7) // 8].tobytes()


def lzw_decode(data: bytes, bits: int = 8) -> bytes:
    """The samples of a code stream; it may end with or without its end code."""
    clear, limit = 1 << bits, 8 * len(data)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    # widths after a clear code: the table has one entry fewer than codes read
    room = 4096 - clear - 2
    template = np.maximum(np.floor(np.log2(np.arange(room + 1) + clear + 1)).astype(np.int64) + 1, bits + 1)
    template = np.minimum(template, 12)
    template[0] = bits + 1
    out: list[bytes] = []
    at = 0
    while at < limit:
        offsets = at + np.concatenate(([0], np.cumsum(template)))
        n = int(np.searchsorted(offsets, limit, "right")) - 1
        if n <= 0:
            break
        widths = template[:n]
        begins = offsets[:n]
        byte = begins >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (begins & 7)) & ((1 << widths) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if len(stop):
            n = int(stop[0])
            ended = codes[n] == clear + 1
            at = int(begins[n] + widths[n])
        else:
            at, ended = int(offsets[n]), False
        _run(codes[:n].tolist(), clear, out)
        if ended:
            break
        if not len(stop) and n == len(template):  # a full table that is not cleared: 12-bit codes, nothing new
            at = _full(raw, at, limit, codes[:n].tolist(), clear, out)
            if at < 0:
                break
    return b"".join(out)


def _run(codes: list[int], clear: int, out: list[bytes]) -> list[bytes]:
    """Strings of the codes between two clear codes."""
    table = [bytes((x,)) for x in range(clear)] + [b"", b""]
    if not codes:
        return table
    if codes[0] >= clear:
        raise ValueError("first code is not a sample")
    prev = table[codes[0]]
    add, new, size = out.append, table.append, len(table)
    add(prev)
    for c in codes[1:]:
        if c < size:
            cur = table[c]
            new(prev + cur[:1])
        elif c == size:
            cur = prev + prev[:1]
            new(cur)
        else:
            raise ValueError("code beyond the table")
        size += 1
        add(cur)
        prev = cur
    return table


def _full(raw: np.ndarray, at: int, limit: int, codes: list[int], clear: int, out: list[bytes]) -> int:
    table = _run(codes, clear, [])
    while at + 12 <= limit:
        b = at >> 3
        c = int((raw[b] | raw[b + 1] << 8 | raw[b + 2] << 16) >> (at & 7) & 4095)
        at += 12
        if c == clear:
            return at
        if c == clear + 1:
            return -1
        if c >= len(table):
            raise ValueError("code beyond the table")
        out.append(table[c])
    return -1


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(p),)) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def palettes() -> tuple[np.ndarray, np.ndarray]:
    """Two palettes of 256 colours, all different: three bits of red and green and two of blue, and the same with the channels turned."""
    i = np.arange(256)
    one = np.stack((i >> 5, i >> 2 & 7, i & 3), 1) * np.array([36, 36, 85])
    return one.astype(np.uint8), one[:, [1, 2, 0]].astype(np.uint8)


def encode(samples: bytes, rows: int = MAX_ROWS) -> bytes:
    """A GIF whose frames, in turn, hold the samples as palette indices; their number is a positive multiple of 64.

    Frames are at most ``rows`` high. Every other one has a palette of its own and is transparent where its sample is that of its first pixel; disposal methods 1, 2 and 3
    take turns. So the samples are lossless, whatever the canvas shows.
    """
    if not samples or len(samples) % WIDTH:
        raise ValueError("samples must be a positive multiple of 64")
    step = WIDTH * rows
    parts = [samples[i : i + step] for i in range(0, len(samples), step)]
    one, other = (p.tobytes() for p in palettes())
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, len(parts[0]) // WIDTH, 0xF7, 0, 0), one]
    for k, p in enumerate(parts):
        odd = k % 2
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", (1 + k % 3) << 2 | odd, DELAY_CS, p[0] if odd else 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(p) // WIDTH, 0x87 if odd else 0) + (other if odd else b"") + b"\x08")
        out.append(_blocks(lzw_encode(p)))
    return b"".join([*out, b"\x3b"])


def decode(data: bytes, canvases: bool = False) -> Iterator[Frame]:
    """The frames of a GIF, in turn; one canvas is held at a time."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = clock = 0
    transparent: int | None = None

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = sub_blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0] * 10
                transparent = body[3] if body[0] & 1 else None
            at = after
            continue
        if data[at] != 0x2C:
            raise ValueError(f"unknown block {data[at]:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette
        if flags & 0x80:
            n = 2 << (flags & 7)
            colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if colours is None:
            raise ValueError("no palette")
        bits = data[at]
        stream, at = sub_blocks(at + 1)
        flat = np.frombuffer(lzw_decode(stream, bits), np.uint8)
        if len(flat) < w * h:
            raise ValueError("too few samples")
        indices = flat[: w * h].reshape(h, w)
        if flags & 0x40:
            rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(indices)
            straight[rows] = indices
            indices = straight
        if len(indices) and indices.max(initial=0) >= len(colours):
            raise ValueError("index beyond the palette")
        before = canvas.copy() if disposal == 3 else None
        covers = (left, top) == (0, 0) and w >= width and h >= height and transparent is None
        area = canvas[top : top + h, left : left + w]
        shown = indices[: area.shape[0], : area.shape[1]]
        if covers:  # counted on indices, which are a quarter of the canvas
            counts = np.bincount(shown.ravel(), minlength=len(colours))
            histogram = [int(x) for c in range(3) for x in np.bincount(colours[:, c] >> 6, counts, BINS)]
        if not covers or canvases or disposal != 2:
            drawn = np.concatenate((colours, np.full((len(colours), 1), 255, np.uint8)), 1)[shown]
            area[...] = np.where((shown == transparent)[..., None], area, drawn) if transparent is not None else drawn
        if not covers:
            seen = canvas[canvas[..., 3] > 0]
            histogram = [int(x) for c in range(3) for x in np.bincount(seen[:, c] >> 6, minlength=BINS)]
        yield Frame(left, top, indices, clock, delay, disposal, transparent, histogram, canvas.copy() if canvases else None)
        clock += delay
        if disposal == 2:
            area[...] = 0
        elif before is not None:
            canvas = before
        delay = disposal = 0
        transparent = None


def frame_rows(files: DataFrame, key: str, content: str, errors: str = "skip") -> DataFrame:
    """A row per frame of the GIF in ``content``: key, frame, times, geometry, the histogram of three channels."""
    fields = "frame int, start_ms long, delay_ms long, left int, top int, width int, height int, disposal int, transparent int, histogram array<long>, samples binary, error string"

    def run(batches):
        for batch in batches:
            rows = []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for i, f in enumerate(decode(body or b"")):
                        h, w = f.indices.shape
                        rows.append((k, i, f.start_ms, f.delay_ms, f.left, f.top, w, h, f.disposal, f.transparent, f.histogram, f.indices.tobytes(), None))
                except (ValueError, IndexError, struct.error) as e:
                    if errors == "null":
                        rows.append((k, *[None] * 11, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds_pa)], names=kinds.names)

    kinds = files.select(key).schema
    for f in schema(fields):
        kinds = kinds.add(f)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds_pa = [to_arrow_type(f.dataType) for f in kinds]
    return files.select(key, content).mapInArrow(lean(run), kinds)


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as a GIF, read back: the columns of the query, from the stored bytes."""
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames int, duration_ms long"

    def one(body: bytes) -> tuple:
        media = encode(body + bytes(-len(body) % WIDTH if body else WIDTH))
        digest, size, tail, last, hist, n = hashlib.sha256(), 0, b"", 0, np.zeros(3 * BINS, np.int64), 0
        for f in decode(media):
            samples = f.indices.tobytes()
            digest.update(samples)
            size, tail, last, n = size + len(samples), samples[-64:], f.start_ms + f.delay_ms, n + 1
            hist += f.histogram
        return (len(body), size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), "gif:" + ",".join(map(str, hist)), n, last)

    def run(batches):
        for batch in slices(batches, text):
            rows = [one(t) for t in text_of(batch, text).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds_pa, strict=True))], names=kinds.names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = docs.select(key).schema
    for f in schema(fields):
        kinds = kinds.add(f)
    kinds_pa = [to_arrow_type(f.dataType) for f in kinds.fields[1:]]
    return docs.select(key, text).mapInArrow(lean(run), kinds)


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(load(spark, sf_dir, "documents"))
