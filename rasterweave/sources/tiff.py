"""A small TIFF codec. It reads strips and tiles, classic and big files, any number of bands and of their types, raw,
packbits, LZW or deflate, with horizontal and floating point predictors; it writes strips, raw or deflate. The common
georeferencing tags are read and written."""

from __future__ import annotations

import struct
import zlib
from typing import Any

import numpy as np

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
#: Tag numbers of the format and of its georeferencing extension.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 317, 339
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113


def _entries(data: bytes) -> tuple[str, dict[int, Any]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = struct.unpack(order + "H", data[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    # Places are of 4 bytes in classic files and of 8 in big ones, and so is the field of an entry.
    place, width, count, entry = ("I", 4, "H", 12) if version == 42 else ("Q", 8, "Q", 20)
    at = struct.unpack(order + place, data[width : 2 * width])[0] if version == 42 else struct.unpack(order + "Q", data[8:16])[0]
    n_entries = struct.unpack_from(order + count, data, at)[0]
    at += struct.calcsize(order + count)
    out: dict[int, Any] = {}
    for k in range(n_entries):
        p = at + entry * k
        tag, kind, n = struct.unpack_from(order + "HH" + place, data, p)
        size, field = _SIZES.get(kind, 1) * n, p + 4 + width
        q = field if size <= width else struct.unpack_from(order + place, data, field)[0]
        raw = data[q : q + size]
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace")
        elif kind in _CODES:
            out[tag] = struct.unpack(f"{order}{n}{_CODES[kind]}", raw)
    return order, out


def header(data: bytes) -> dict[str, Any]:
    """What the file says about itself; pixels are not decoded."""
    _, t = _entries(data)
    one = lambda tag, default: (t.get(tag) or (default,))[0]
    bands = one(SAMPLES, 1)
    bits, forms = t.get(BITS, (1,)), t.get(FORMAT, (1,))
    kinds = [np.dtype(_KINDS[(forms[min(k, len(forms) - 1)], bits[min(k, len(bits) - 1)])]).name for k in range(bands)]
    width, height = one(WIDTH, 0), one(HEIGHT, 0)
    affine = None
    if TRANSFORM in t:
        m = t[TRANSFORM]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif PIXEL_SCALE in t and TIE_POINT in t:
        sx, sy = t[PIXEL_SCALE][:2]
        i, j, _, x, y, _ = t[TIE_POINT][:6]
        affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    epsg = None
    keys = t.get(GEO_KEYS, ())
    for k in range(4, len(keys) - 3, 4):
        if keys[k] in (3072, 2048) and keys[k + 1] == 0 and (epsg is None or keys[k] == 3072):
            epsg = keys[k + 3]
    bounds = None
    if affine:
        a, b, c, d, e, f = affine
        xs, ys = [c + a * u + b * v for u in (0, width) for v in (0, height)], [f + d * u + e * v for u in (0, width) for v in (0, height)]
        bounds = (min(xs), min(ys), max(xs), max(ys))
    try:
        nodata = float(t[NODATA]) if NODATA in t else None
    except ValueError:
        nodata = None
    text = t.get(DESCRIPTION)
    return {
        "driver": "GTiff", "width": width, "height": height, "count": bands, "dtypes": kinds, "nodata": nodata, "crs": f"EPSG:{epsg}" if epsg else None, "epsg": epsg,
        "res": (abs(affine[0]), abs(affine[4])) if affine else None, "bounds": bounds, "affine": affine, "descriptions": (text.split("\n") if text else [None] * bands),
        "apart": one(PLANAR, 1) == 2,
    }


def unpacked(raw: bytes) -> bytes:
    """PackBits runs."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += raw[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def lzw(raw: bytes) -> bytes:
    """The LZW coding of the format: codes of 9 to 12 bits from the high bit on, 256 to clear, 257 to end."""
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last, bits, held, width = list(fresh), [], b"", 0, 0, 9
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = list(fresh), b"", 9
            continue
        if not last:
            last = table[code]
        else:
            now = table[code] if code < len(table) else last + last[:1]
            table.append(last + now[:1])
            last = now
        out.append(last)
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def _block(raw: bytes, coding: int, predictor: int, kind: np.dtype, order: str, rows: int, columns: int, samples: int) -> np.ndarray:
    """A strip or tile as (rows, columns, samples); fewer rows than stated are given if fewer are there."""
    if coding in (8, 32946):
        raw = zlib.decompress(raw)
    elif coding == 5:
        raw = lzw(raw)
    elif coding == 32773:
        raw = unpacked(raw)
    elif coding != 1:
        raise ValueError(f"compression {coding} is not supported")
    line = columns * samples
    rows = min(rows, len(raw) // (line * kind.itemsize))
    if predictor == 3:  # bytes of a row by significance, highest first, as differences
        planes = np.frombuffer(raw, np.uint8, rows * line * kind.itemsize).reshape(rows, -1, samples)
        planes = np.add.accumulate(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, line)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, columns, samples).astype(kind)
    out = np.frombuffer(raw, kind.newbyteorder(order), rows * line).reshape(rows, columns, samples).astype(kind)
    if predictor == 2:
        out = np.add.accumulate(out, axis=1, dtype=kind)
    elif predictor != 1:
        raise ValueError(f"predictor {predictor} is not supported")
    return out


def decode(data: bytes, bands: list[int] | None = None) -> tuple[np.ndarray, dict[str, Any]]:
    """(bands, rows, columns) of the chosen bands (from 1; None: all) and the header. Of files that hold bands apart,
    only the chosen bands' blocks are inflated; bands of several types come as the least type that holds all."""
    order, t = _entries(data)
    info = header(data)
    one = lambda tag, default: (t.get(tag) or (default,))[0]
    coding, predictor, apart = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2
    h, w, n = info["height"], info["width"], info["count"]
    wanted = bands or list(range(1, n + 1))
    if any(not 1 <= b <= n for b in wanted):
        raise ValueError(f"bands lie in 1..{n}")
    kinds = [np.dtype(k) for k in info["dtypes"]]
    if not apart and len(set(kinds)) > 1:
        raise ValueError("interleaved bands of several types are not supported")
    tiled = TILE_WIDTH in t
    columns, rows = (one(TILE_WIDTH, w), one(TILE_HEIGHT, h)) if tiled else (w, min(one(ROWS, h), h) or 1)
    across, down = -(-w // columns), -(-h // rows)
    places, sizes = (t[TILE_OFFSETS], t[TILE_COUNTS]) if tiled else (t[OFFSETS], t[COUNTS])
    out = np.zeros((len(wanted), h, w), np.result_type(*[kinds[b - 1] for b in wanted]))
    for first, picked in [(b - 1, [i]) for i, b in enumerate(wanted)] if apart else [(0, list(range(len(wanted))))]:
        for k in range(across * down):
            at = (first * across * down if apart else 0) + k
            y, x = k // across * rows, k % across * columns
            if sizes[at] == 0:  # a sparse block
                continue
            got = _block(data[places[at] : places[at] + sizes[at]], coding, predictor, kinds[first], order, rows, columns, 1 if apart else n)
            got = got[: h - y, : w - x]
            for i in picked:
                out[i, y : y + got.shape[0], x : x + got.shape[1]] = got[:, :, 0 if apart else wanted[i] - 1]
    return out, info


def encode(array: np.ndarray, affine: tuple | None = None, epsg: int | None = None, nodata: float | None = None, descriptions: list[str | None] | None = None, compress: bool = True) -> bytes:
    """(bands, rows, columns) as a little-endian file, a strip a band."""
    array = array[None] if array.ndim == 2 else array
    n, h, w = array.shape
    form, bits = next(k for k, v in _KINDS.items() if np.dtype(v) == array.dtype)
    strips = [np.ascontiguousarray(b, array.dtype.newbyteorder("<")).tobytes() for b in array]
    strips = [zlib.compress(s, 6) for s in strips] if compress else strips
    fields: list[tuple[int, int, Any]] = [
        (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [bits] * n), (COMPRESSION, 3, [8 if compress else 1]), (PHOTOMETRIC, 3, [1]), (OFFSETS, 4, [0] * n), (SAMPLES, 3, [n]),
        (ROWS, 4, [h]), (COUNTS, 4, [len(s) for s in strips]), (PLANAR, 3, [2 if n > 1 else 1]), (FORMAT, 3, [form] * n),
    ]
    if descriptions and any(descriptions):
        fields.append((DESCRIPTION, 2, "\n".join(d or "" for d in descriptions)))
    if affine:
        a, b, c, d, e, f = affine
        if b == d == 0 and e < 0:
            fields += [(PIXEL_SCALE, 12, [a, -e, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, c, f, 0.0])]
        else:
            fields.append((TRANSFORM, 12, [a, b, 0.0, c, d, e, 0.0, f, 0, 0, 0, 0, 0, 0, 0, 1.0]))
    if epsg:
        projected = not 4000 <= epsg < 5000
        fields.append((GEO_KEYS, 3, [1, 1, 0, 2, 1024, 0, 1, 1 if projected else 2, 3072 if projected else 2048, 0, 1, epsg]))
    if nodata is not None:
        fields.append((NODATA, 2, repr(float(nodata))))
    fields.sort()
    start = 8 + 2 + 12 * len(fields) + 4
    extra, table = b"", b""
    packed = {tag: (v.encode() + b"\0") if kind == 2 else struct.pack(f"<{len(v)}{_CODES[kind]}", *v) for tag, kind, v in fields}
    tail = sum(len(p) + len(p) % 2 for p in packed.values() if len(p) > 4)
    at = start + tail
    places = []
    for s in strips:
        places.append(at)
        at += len(s)
    packed[OFFSETS] = struct.pack(f"<{n}I", *places)
    for tag, kind, v in fields:
        p = packed[tag]
        size = len(p) if kind == 2 else len(v)
        if len(p) <= 4:
            table += struct.pack("<HHI", tag, kind, size) + p.ljust(4, b"\0")
        else:
            table += struct.pack("<HHII", tag, kind, size, start + len(extra))
            extra += p + b"\0" * (len(p) % 2)
    return b"II*\0" + struct.pack("<IH", 8, len(fields)) + table + b"\0\0\0\0" + extra + b"".join(strips)


def png(array: np.ndarray) -> bytes:
    """A gray (rows, columns) or RGB (rows, columns, 3) byte image as PNG."""
    a = np.ascontiguousarray(array, np.uint8)
    h, w = a.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
