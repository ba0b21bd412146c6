"""TIFF media columns: image directories are walked and each page becomes a row.

Strips and tiles, stored plain or by PackBits, LZW or deflate, in either byte order,
of samples of 8, 16, 32 or 64 bits, together or in separate planes; the predictors
for differences (2) and for floating point (3) are undone. Pixels are given as
little-endian samples, row by row. The writer makes such files for tests and for
storing byte payloads.

Edge cases: null or empty media has no page; a page of an unsupported kind or with
damaged data is a row whose error says what is wrong, and the pages behind it
follow; where the directory itself can't be read, that row is the last; a chain of
directories that returns to itself ends. What a header says is checked against the
file before memory is taken for it. Equal media give equal rows; null and repeated
keys keep their rows; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import flat, table

PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes a pixel row of a stored payload holds (192 pixels of 3 samples), and rows a page.
ROW, PAGE_ROWS = 576, 256
_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}
#: Most bytes that a stored byte can stand for.
_MOST = {PLAIN: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}
_BITS = (8, 16, 32, 64)


# LZW: codes of 9 to 12 bits, most significant bit first, one code early.
def _widths() -> np.ndarray:
    """Width of the n-th code after a clear code, up to the table's end."""
    n = np.arange(4096 - 257)
    size = 258 + np.maximum(n - 1, 0)  # entries when the n-th code is read
    return np.select([size + (n > 0) <= 511, size + (n > 0) <= 1023, size + (n > 0) <= 2047], [9, 10, 11], 12)


_W = _widths()
_AT = np.concatenate([[0], np.cumsum(_W)])


def lzw_decode(raw: bytes, limit: int = 1 << 62) -> bytes:
    bits = np.frombuffer(raw + b"\0\0\0\0", np.uint8).astype(np.int64)
    total, pos, out, size = len(raw) * 8, 0, [], 0
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    while pos + 9 <= total and size < limit:
        at = pos + _AT
        n = int(np.searchsorted(at, total, "right")) - 1
        at, width = at[:n], _W[:n]
        byte = at >> 3
        word = (bits[byte] << 24) | (bits[byte + 1] << 16) | (bits[byte + 2] << 8) | bits[byte + 3]
        codes = (word >> (32 - (at & 7) - width)) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        k = int(stop[0]) if len(stop) else n
        entries, last = list(base), None
        for c in codes[:k].tolist():
            if c < len(entries):
                now = entries[c]
            elif c == len(entries) and last is not None:
                now = last + last[:1]
            else:
                raise ValueError("LZW code outside the table")
            out.append(now)
            size += len(now)
            if last is not None:
                entries.append(last + now[:1])
            last = now
        if k == n or codes[k] == 257:
            break
        pos = int(at[k] + width[k])
    return b"".join(out)


def lzw_encode(raw: bytes) -> bytes:
    fresh = {bytes([i]): i for i in range(256)}
    codes, widths, start = [256], [np.array([9])], 0
    entries, prefix, n = dict(fresh), b"", 0
    seg: list[int] = []
    for i in range(len(raw)):
        longer = prefix + raw[i : i + 1]
        if longer in entries:
            prefix = longer
            continue
        seg.append(entries[prefix])
        entries[longer] = 258 + n
        n += 1
        prefix = raw[i : i + 1]
        if n == 4093 - 258:
            seg.append(256)
            codes += seg
            widths.append(_W[: len(seg)])
            entries, n, seg = dict(fresh), 0, []
    if prefix:
        seg.append(entries[prefix])
    seg.append(257)
    codes += seg
    widths.append(_W[: len(seg)])
    code, width = np.array(codes), np.concatenate(widths)
    shift = width[:, None] - 1 - np.arange(12)[None, :]
    bit = (code[:, None] >> np.maximum(shift, 0)) & 1
    return np.packbits(bit[shift >= 0].astype(np.uint8)).tobytes()


def packbits_encode(raw: bytes) -> bytes:
    """Runs of three bytes and more are packed, the rest is literal."""
    if not raw:
        return b""
    a = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    size = np.diff(np.append(edge, len(a)))
    out, at = [], 0

    def literal(to: int) -> None:
        for k in range(at, to, 128):
            part = raw[k : min(k + 128, to)]
            out.append(bytes([len(part) - 1]) + part)

    for s, n in zip(edge[size >= 3].tolist(), size[size >= 3].tolist(), strict=True):
        literal(s)
        value = raw[s : s + 1]
        full, rest = divmod(n, 128)
        out.append((b"\x81" + value) * full)
        at = s + n
        if rest > 1:
            out.append(bytes([257 - rest]) + value)
        elif rest:
            out.append(b"\0" + value)
    literal(len(raw))
    return b"".join(out)


def packbits_decode(raw: bytes, limit: int = 1 << 62) -> bytes:
    out, i, n = [], 0, len(raw)
    while i < n:
        c = raw[i]
        if c < 128:
            out.append(raw[i + 1 : i + 2 + c])
            i += 2 + c
        elif c > 128:
            out.append(raw[i + 1 : i + 2] * (257 - c))
            i += 2
        else:
            i += 1
    return b"".join(out)


def inflate(raw: bytes, limit: int = 1 << 62) -> bytes:
    return zlib.decompressobj().decompress(raw, min(limit, 1 << 31))


_DECODE = {PLAIN: lambda raw, limit: raw, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: packbits_decode}
_ENCODE = {PLAIN: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 6), PACKBITS: packbits_encode}


def _difference(part: np.ndarray, predictor: int, order: str) -> bytes:
    """A part's bytes (rows x columns x samples) as a predictor stores them."""
    if predictor == 2:
        part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
    if predictor == 3:  # the bytes of a row by their weight, then differences
        h, w, spp = part.shape
        planes = part.astype(part.dtype.newbyteorder(">")).reshape(h, w * spp).view(np.uint8).reshape(h, w * spp, -1).transpose(0, 2, 1).reshape(h, -1)
        return np.concatenate([planes[:, :spp], planes[:, spp:] - planes[:, :-spp]], axis=1).tobytes()
    return part.astype(part.dtype.newbyteorder(order)).tobytes()


def _undo(data: bytes, shape: tuple[int, int, int], bits: int, predictor: int, order: str) -> np.ndarray:
    h, w, spp = shape
    kind = np.dtype(f"u{bits // 8}")
    if predictor == 3:
        raw = np.frombuffer(data, np.uint8, h * w * spp * kind.itemsize).reshape(h, -1)
        pad = raw.reshape(h, -1, spp)
        planes = np.cumsum(pad, axis=1, dtype=np.uint8).reshape(h, kind.itemsize, w * spp)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(h, -1).view(kind.newbyteorder(">")).astype(kind).reshape(shape)
    part = np.frombuffer(data, kind.newbyteorder(order), h * w * spp).reshape(shape).astype(kind)
    return np.cumsum(part, axis=1, dtype=kind) if predictor == 2 else part


def write_tiff(pages: list[tuple], order: str = "<") -> bytes:
    """A file of pages: pixels (height x width x samples), compression, predictor, tile size or rows a strip, and if given whether planes are separate."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for pixels, compression, predictor, layout, *separate in pages:
        h, w, spp = pixels.shape
        planes = [pixels[:, :, i : i + 1] for i in range(spp)] if separate and separate[0] else [pixels]
        parts = []
        for plane in planes:
            if isinstance(layout, tuple):
                tw, th = layout
                for y in range(0, h, th):
                    for x in range(0, w, tw):
                        tile = np.zeros((th, tw, plane.shape[2]), pixels.dtype)
                        own = plane[y : y + th, x : x + tw]
                        tile[: own.shape[0], : own.shape[1]] = own
                        parts.append(tile)
            else:
                parts += [plane[y : y + layout] for y in range(0, h, layout)]
        at, sizes = [], []
        for part in parts:
            raw = _ENCODE[compression](_difference(part, predictor, order))
            at.append(len(out))
            sizes.append(len(raw))
            out += raw + b"\0" * (len(raw) & 1)
        tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * pixels.dtype.itemsize] * spp), (259, 3, [compression]), (262, 3, [2 if spp == 3 else 1]), (277, 3, [spp]), (284, 3, [2 if len(planes) > 1 else 1]), (317, 3, [predictor])]
        tags += [(322, 4, [layout[0]]), (323, 4, [layout[1]]), (324, 4, at), (325, 4, sizes)] if isinstance(layout, tuple) else [(273, 4, at), (278, 4, [layout]), (279, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{_TYPES[kind]}", *values)
            if len(raw) > 4:
                entries.append(struct.pack(order + "HHII", tag, kind, len(values), len(out)))
                out += raw + b"\0" * (len(raw) & 1)
            else:
                entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


_DAMAGE = (ValueError, KeyError, struct.error, zlib.error, IndexError, OverflowError, MemoryError)


def _tags(raw: bytes, at: int, n: int, order: str) -> dict[int, tuple]:
    tags: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        if kind in _TYPES:
            size = count * struct.calcsize(_TYPES[kind])
            where = at + 10 + 12 * i
            where = where if size <= 4 else struct.unpack_from(order + "I", raw, where)[0]
            if where + size > len(raw):
                raise ValueError(f"tag {tag} lies outside the file")
            tags[tag] = struct.unpack_from(f"{order}{count}{_TYPES[kind]}", raw, where)
    return tags


def _page(raw: bytes, tags: dict[int, tuple], order: str) -> dict:
    w, h, spp = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    compression, predictor, planar = tags.get(259, (1,))[0], tags.get(317, (1,))[0], tags.get(284, (1,))[0]
    bits = tags.get(258, (1,))
    if len(set(bits)) != 1 or bits[0] not in _BITS or planar not in (1, 2) or compression not in _DECODE or predictor not in (1, 2, 3) or tags.get(266, (1,))[0] != 1:
        raise ValueError("a page of an unsupported kind")
    if not (w and h and spp):
        raise ValueError("a page without pixels")
    width, tiled = bits[0] // 8, 322 in tags
    tw, th = (tags[322][0], tags[323][0]) if tiled else (w, min(tags.get(278, (h,))[0], h))
    if not (tw and th):
        raise ValueError("strips or tiles without pixels")
    starts, sizes = tags[324 if tiled else 273], tags[325 if tiled else 279]
    planes, deep = (spp, 1) if planar == 2 else (1, spp)
    across, down = -(-w // tw), -(-h // th)
    if len(starts) != len(sizes) or len(starts) != across * down * planes:
        raise ValueError("another number of strips or tiles than the page has")
    if any(s + n > len(raw) for s, n in zip(starts, sizes, strict=True)):
        raise ValueError("a strip or tile lies outside the file")
    if any((th if tiled else min(th, h - i // across % down * th)) * tw * deep * width > n * _MOST[compression] + 4096 * (compression != PLAIN) for i, n in enumerate(sizes)):
        raise ValueError("a strip or tile is too short")
    pixels = np.zeros((h, w, spp), f"<u{width}")
    for i, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        plane, rest = divmod(i, across * down)
        y, x = rest // across * th, rest % across * tw
        shape = (th if tiled else min(th, h - y), tw, deep)
        need = shape[0] * shape[1] * shape[2] * width
        data = _DECODE[compression](raw[start : start + size], need)
        if len(data) < need:
            raise ValueError("a strip or tile is too short")
        part = _undo(data[:need], shape, bits[0], predictor, order)
        pixels[y : y + th, x : x + tw, plane * deep : plane * deep + deep] = part[: h - y, : w - x]
    return {"width": w, "height": h, "samples": spp, "bits": bits[0], "compression": compression, "predictor": predictor, "tiled": tiled, "pixels": pixels.tobytes()}


def read_pages(raw: bytes | None) -> Iterator[dict]:
    """Each page of a file, walked by its directories; one with an error alone where a page can't be read."""
    if not raw:
        return
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not order or len(raw) < 8 or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        yield {"error": "no TIFF header"}
        return
    at, seen = struct.unpack_from(order + "I", raw, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", raw, at)
            following = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]
        except struct.error as e:
            yield {"error": f"a directory lies outside the file: {e}"}
            return
        try:
            yield _page(raw, _tags(raw, at, n, order), order)
        except _DAMAGE as e:
            yield {"error": f"{type(e).__name__}: {e}"}
        at = following


PAGE = {"page": pa.int32(), "width": pa.int32(), "height": pa.int32(), "samples": pa.int32(), "bits": pa.int32(), "compression": pa.int32(), "predictor": pa.int32(), "tiled": pa.bool_(), "pixels": pa.binary(), "error": pa.string()}


def pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row for each page of each file of df: key, page from 0, its shape, storage and pixels; or an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in zip(batch.column(0), batch.column(1), strict=True):
                got = [dict.fromkeys(PAGE) | {"page": n} | p for n, p in enumerate(read_pages(raw.as_py()))]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(got), batch.schema.types[0]), *(pa.array([p[c] for p in got], t) for c, t in PAGE.items())], names=[key, *PAGE])

    return df.select(key, media).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string")


def pack_payload(text: bytes) -> bytes:
    """Bytes with 255s up to a positive multiple of ROW, as a file whose pages are stored in turn in each way.

    How is drawn from the payload's CRC, so that equal payloads make equal files:
    most pages are deflated, one in eight each takes LZW, PackBits or tiles.
    """
    payload = text + b"\xff" * (-len(text) % ROW or (0 if text else ROW))
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    draw = zlib.crc32(payload)
    out = []
    for k, y in enumerate(range(0, len(pixels), PAGE_ROWS)):
        how = (draw + k) % 8
        compression = LZW if how == 0 else PACKBITS if how == 1 else DEFLATE
        out.append((pixels[y : y + PAGE_ROWS], compression, 2 if how in (0, 2, 3) else 1, (64, 16) if how == 2 else 64))
    return write_tiff(out)


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media (the TIFF file) of each text; null is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(1))
            for i in range(0, len(off) - 1, 256):
                j = min(i + 256, len(off) - 1)
                media = [pack_payload(data[off[d] : off[d + 1]].tobytes()) for d in range(i, j)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(off[i : j + 1]), pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def features(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored files of stored() hold, read back page by page: digests and pixel features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for media in batch.column(2):
                raw = media.as_py()
                got = list(read_pages(raw))
                payload = b"".join(p["pixels"] for p in got)
                a = np.frombuffer(payload, np.uint8)
                hist = np.bincount(a >> 5, minlength=8)
                how = "".join(sorted({{LZW: "l", PACKBITS: "p", DEFLATE: "d"}[p["compression"]] + ("t" if p["tiled"] else "") for p in got}))
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), f"{len(got)}p {how} mean {int(a.sum(dtype=np.int64)) / len(a):.3f} steps {int((a[1:] != a[:-1]).sum())} hist {','.join(map(str, hist))}"))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return df.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(stored(table(spark, sf_dir, "documents")))
