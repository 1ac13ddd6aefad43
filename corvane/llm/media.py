"""Payloads in PNG columns: zlib chunks with checksum tests, numpy unfiltering, cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import fresh

WIDTH = 64
LEVEL = 1
SIDE = 32
#: The 8-byte signature that opens a PNG stream (fixed value).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes in one IDAT chunk.
CHUNK = 1 << 20
#: Bytes of images that are filtered, or unfiltered, at once; a larger image goes alone.
TOGETHER = 4 << 20
#: Rows whose filters are tried at once.
BLOCK = 1 << 15


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _predictions(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> list[np.ndarray]:
    """What each filter kind predicts from the bytes to the left, above and above left: none, sub, up, average, Paeth."""
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    to_a, to_b, to_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    paeth = np.where((to_a <= to_b) & (to_a <= to_c), left, np.where(to_b <= to_c, up, corner))
    return [np.zeros_like(left), left, up, ((a + b) >> 1).astype(np.uint8), paeth]


def filtered(samples: np.ndarray, first: np.ndarray, filters: np.ndarray | int | None = None) -> np.ndarray:
    """Rows of images that follow each other (first: the row of each image has none above) -> filter kind, filtered bytes.

    Without given filters each row takes the kind of the smallest sum of signed residuals, the lower kind of equal sums.
    """
    kinds = np.zeros(len(samples), np.uint8) if filters is None else np.broadcast_to(np.asarray(filters, np.uint8), (len(samples),)).copy()
    lines = np.empty((len(samples), samples.shape[1] + 1), np.uint8)
    for lo in range(0, len(samples), BLOCK):
        part, top = samples[lo : lo + BLOCK], first[lo : lo + BLOCK]
        left, up, corner = (np.zeros_like(part) for _ in range(3))
        left[:, 1:], up[1:] = part[:, :-1], part[:-1]
        up[0] = samples[lo - 1] if lo else 0
        up[top] = 0
        corner[:, 1:] = up[:, :-1]
        tried = np.stack([part - p for p in _predictions(left, up, corner)])
        if filters is None:
            kinds[lo : lo + BLOCK] = np.abs(tried.view(np.int8).astype(np.int16)).sum(2, dtype=np.int32).argmin(0)
        lines[lo : lo + BLOCK, 1:] = tried[kinds[lo : lo + BLOCK], np.arange(len(part))]
    lines[:, 0] = kinds
    return lines


def _png(lines: np.ndarray, level: int) -> bytes:
    rows, columns = lines.shape[0], lines.shape[1] - 1
    packed = zlib.compress(np.ascontiguousarray(lines), level)
    body = b"".join(_chunk(b"IDAT", packed[k : k + CHUNK]) for k in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def encode_png(samples: np.ndarray, filters: np.ndarray | int | None = None, level: int = LEVEL) -> bytes:
    """8-bit grey samples (rows x columns) -> PNG; filters 0 none, 1 sub, 2 up, 3 average, 4 Paeth for each row or for all, or chosen."""
    return _png(filtered(samples, np.arange(len(samples)) == 0, filters), level)


def unfilter(lines: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Filtered rows of images of one width that follow each other -> samples; first marks the top rows of the images.

    A byte needs those to its left, above and above left, so bytes of one anti-diagonal of an image are free of each
    other: step t takes column t - r of row r in all images together, as many vector steps as rows and columns of the tallest.
    """
    n, width = lines.shape[0], lines.shape[1] - 1
    kinds = lines[:, 0]
    if n == 0 or not kinds.any():
        return lines[:, 1:].copy()
    if kinds.max() > 4:
        raise ValueError("unknown filter")
    first = np.arange(n) == 0 if first is None else first
    top = np.flatnonzero(first)
    depth = np.arange(n) - np.repeat(top, np.diff(np.append(top, n)))
    order = np.argsort(depth, kind="stable")
    sorted_depth = depth[order]
    pad = width + 1
    out = np.zeros((n + 1) * pad, np.uint8)  # a zero column before each row, and a zero row at the end
    row_at, above_at = order * pad, np.where(sorted_depth == 0, n, order - 1) * pad
    raw, kind = lines.reshape(-1), kinds[order]
    last = int(sorted_depth[-1])
    bounds = np.searchsorted(sorted_depth, np.arange(last + 2))
    for t in range(last + width):
        lo, hi = bounds[max(0, t - width + 1)], bounds[min(t, last) + 1]
        at = t - sorted_depth[lo:hi] + 1
        here, above, k = row_at[lo:hi] + at, above_at[lo:hi] + at, kind[lo:hi]
        guess = np.choose(k, _predictions(out[here - 1], out[above], out[above - 1]))
        out[here] = raw[here] + guess  # lines have the same stride: a kind, then the bytes
    return out[: n * pad].reshape(n, pad)[:, 1:].copy()


def read_png(data: bytes) -> np.ndarray:
    """PNG of 8-bit grey samples -> its filtered rows; raises ValueError if a chunk's checksum, order or size is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG stream")
    at, head, packed, ended = 8, None, [], False
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body, crc = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(crc) != 4 or struct.unpack(">I", crc)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only whole 8-bit grey images without interlace are read")
    columns, rows = head[:2]
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != rows * (columns + 1):
        raise ValueError("the image data has another size")
    lines = np.frombuffer(raw, np.uint8).reshape(rows, columns + 1)
    if rows and lines[:, 0].max() > 4:
        raise ValueError("unknown filter")
    return lines


def decode_png(data: bytes) -> np.ndarray:
    """PNG of 8-bit grey samples -> samples."""
    return unfilter(read_png(data))


def decode_all(images: list[bytes]) -> list[np.ndarray | None]:
    """Samples of each image, None for a damaged one; images of one width are unfiltered together, up to TOGETHER bytes."""
    lines: list[np.ndarray | None] = []
    for data in images:
        try:
            lines.append(read_png(data))
        except (ValueError, struct.error, zlib.error):
            lines.append(None)
    out: list[np.ndarray | None] = [None] * len(lines)
    for group in _together([0 if x is None else x.size for x in lines], [-1 if x is None else x.shape[1] for x in lines]):
        rows = [lines[k] for k in group]
        tops = np.cumsum([0, *[len(x) for x in rows]])
        first = np.zeros(tops[-1], bool)
        first[tops[:-1][np.diff(tops) > 0]] = True
        samples = unfilter(np.concatenate(rows), first)
        for k, lo, hi in zip(group, tops, tops[1:], strict=False):
            out[k] = samples[lo:hi]
    return out


def _together(sizes: list[int], widths: list[int]) -> Iterator[list[int]]:
    """Indices in groups of one width (negative: none), tallest together, of about TOGETHER bytes."""
    group, held = [], 0
    order = sorted((k for k, w in enumerate(widths) if w >= 0), key=lambda k: (widths[k], sizes[k]))
    for k in order:
        if group and (held + sizes[k] > TOGETHER or widths[k] != widths[group[0]]):
            yield group
            group, held = [], 0
        group.append(k)
        held += sizes[k]
    if group:
        yield group


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)).astype(np.float32)


_BASIS = _cosines(SIDE, 8)


def _shrink(samples: np.ndarray) -> np.ndarray:
    """Means over SIDE x SIDE cells; a side shorter than that repeats its lines."""
    for axis in (0, 1):
        n = samples.shape[axis]
        edge = np.arange(SIDE + 1) * n // SIDE
        if n >= SIDE:
            sums = np.add.reduceat(samples, edge[:-1], axis=axis, dtype=np.float32)
            shape = [1, 1]
            shape[axis] = SIDE
            samples = sums / np.diff(edge).reshape(shape)
        else:
            samples = np.take(samples, edge[:-1], axis=axis).astype(np.float32)
    return samples


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: which of the 8 x 8 lowest frequencies exceed the median of those but the mean."""
    low = (_BASIS @ _shrink(samples) @ _BASIS.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload(text: str | None) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of WIDTH."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def store(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, media): the payload as a grey PNG of WIDTH columns; null or empty text: 64 zero bytes.

    Each row of an image has its own filter. Whole texts of any length; repeated rows are stored again, equal texts
    equally; other columns are ignored, an empty table gives an empty result.
    """

    @F.pandas_udf("binary")
    def png(texts: pd.Series) -> pd.Series:
        payloads = [payload(t) for t in texts]
        out: list[bytes] = [b""] * len(payloads)
        for group in _together([len(p) for p in payloads], [WIDTH] * len(payloads)):
            samples = np.frombuffer(b"".join(payloads[k] for k in group), np.uint8).reshape(-1, WIDTH)
            tops = np.cumsum([0, *[len(payloads[k]) // WIDTH for k in group]])
            first = np.zeros(len(samples), bool)
            first[tops[:-1]] = True
            lines = filtered(samples, first)
            for k, lo, hi in zip(group, tops, tops[1:], strict=False):
                out[k] = _png(lines[lo:hi], level)
        return pd.Series(out, dtype=object)

    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), png("text").alias("media"))


def features(media: DataFrame) -> DataFrame:
    """media columns read back: with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, cosine_hash (binary).

    A null or damaged medium has nulls in all but the media columns and `damaged` true; rows are never lost. Columns of
    those names are replaced, all others stay.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "cosine_hash", "damaged"]

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, cosine_hash binary, damaged boolean")
    def read(stored: pd.Series) -> pd.DataFrame:
        images = [b"" if data is None else bytes(data) for data in stored]
        rows = []
        for data, missing, samples in zip(images, stored.isna(), decode_all(images), strict=True):
            own = (None, None) if missing else (len(data), hashlib.sha256(data).hexdigest())
            if samples is None:
                rows.append((None, None, None, *own, None, True))
                continue
            flat = samples.tobytes()
            rows.append((len(flat), hashlib.sha256(flat).hexdigest(), zlib.crc32(flat[-64:]), *own, cosine_hash(samples), False))
        return pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64", "tail_crc32": "Int64", "media_bytes": "Int64"})

    (held,) = fresh(media, "read")
    return media.withColumn(held, read(media["media"])).withColumns({n: F.col(f"{held}.{n}") for n in names}).drop(held)
