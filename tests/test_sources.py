import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave import functions as pt
from rasterweave import sources, streaming
from rasterweave.sources import raster, tiff


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int16", "int32", "float32", "float64"])
@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(kind, compress):
    a = np.random.default_rng(0).integers(0, 120, (3, 7, 5)).astype(kind)
    data = tiff.encode(a, (10.0, 0, 500.0, 0, -10.0, 900.0), 32630, -9.0, ["red", None, "nir"], compress)
    b, info = tiff.decode(data)
    assert b.dtype == a.dtype and (a == b).all()
    assert info["epsg"] == 32630 and info["res"] == (10.0, 10.0) and info["nodata"] == -9 and info["bounds"] == (500.0, 830.0, 550.0, 900.0)
    assert info["descriptions"] == ["red", "", "nir"] and info["dtypes"] == [kind] * 3
    assert (tiff.decode(data, [3])[0][0] == a[2]).all()
    with pytest.raises(ValueError):
        tiff.decode(data, [4])


def lzw_codes(raw):
    """An encoder for the test: the codes with their widths as one bit string."""
    table, bits, last = {bytes([i]): i for i in range(256)}, f"{256:09b}", b""
    n, width = 258, 9
    for b in raw:
        if last + bytes([b]) in table:
            last += bytes([b])
            continue
        bits += f"{table[last]:0{width}b}"
        table[last + bytes([b])] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        last = bytes([b])
        if n == 4094:
            bits += f"{table[last]:0{width}b}" + f"{256:0{width}b}"
            table, last, n, width = {bytes([i]): i for i in range(256)}, b"", 258, 9
    bits += f"{table[last]:0{width}b}" if last else ""
    n, bits = n + 1, bits
    width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    bits += f"{257:0{width}b}"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def tiled(a, side, coding, predictor, big, order):
    """(bands, rows, columns) as tiles, all bands interleaved."""
    n, h, w = a.shape
    kind = a.dtype.newbyteorder(order)
    blocks = []
    for y in range(0, h, side):
        for x in range(0, w, side):
            t = np.zeros((side, side, n), a.dtype)
            part = a[:, y : y + side, x : x + side].transpose(1, 2, 0)
            t[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                t[:, 1:] = t[:, 1:] - t[:, :-1]
            raw = t.astype(kind).tobytes()
            if predictor == 3:
                planes = np.frombuffer(t.astype(a.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(side, side * n, -1).transpose(0, 2, 1).reshape(side, -1, n).copy()
                planes[:, 1:] = planes[:, 1:] - planes[:, :-1]
                raw = planes.tobytes()
            blocks.append({1: bytes, 5: lzw_codes, 8: zlib.compress}[coding](raw))
    form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    place, size = ("Q", 16) if big else ("I", 4)
    fields = [(256, [w]), (257, [h]), (258, [a.dtype.itemsize * 8] * n), (259, [coding]), (277, [n]), (284, [1]), (317, [predictor]), (322, [side]), (323, [side]), (324, [0] * len(blocks)), (325, [len(b) for b in blocks]), (339, [form] * n)]
    width = 8 if big else 4
    start = 16 if big else 8
    after = start + (8 if big else 2) + len(fields) * (20 if big else 12) + width
    kinds = place if big else "I"
    at = after + sum(width * len(v) for _, v in fields if len(v) > 1)
    for i, b in enumerate(blocks):
        fields[9][1][i] = at
        at += len(b)
    head, extra = b"", b""
    for tag, v in fields:
        raw = struct.pack(f"{order}{len(v)}{kinds}", *v)
        field = raw if len(v) == 1 else struct.pack(order + place, after + len(extra))
        extra += b"" if len(v) == 1 else raw
        head += struct.pack(order + "HH" + place, tag, 16 if big else 4, len(v)) + field
    mark = b"II" if order == "<" else b"MM"
    first = struct.pack(order + "HHHQ", 43, 8, 0, 16) + struct.pack(order + "Q", len(fields)) if big else struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(fields))
    return mark + first + head + b"\0" * width + extra + b"".join(blocks)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("big", [True, False])
@pytest.mark.parametrize(("kind", "coding", "predictor"), [("uint8", 5, 1), ("uint16", 5, 2), ("uint16", 8, 2), ("float32", 8, 3), ("float64", 5, 3), ("int16", 1, 1), ("uint8", 8, 2)])
def test_tiles(kind, coding, predictor, big, order):
    a = (np.random.default_rng(3).integers(0, 90, (3, 37, 50)) ** 2 / 3).astype(kind)
    got, info = tiff.decode(tiled(a, 16, coding, predictor, big, order))
    assert got.dtype == a.dtype and (got == a).all() and info["width"] == 50
    assert (tiff.decode(tiled(a, 16, coding, predictor, big, order), [2])[0][0] == a[1]).all()


def test_packed_bits():
    assert tiff.unpacked(bytes([2, 1, 2, 3, 254, 9, 128, 0, 7])) == bytes([1, 2, 3, 9, 9, 9, 7])


def test_not_a_file():
    with pytest.raises(ValueError):
        tiff.header(b"PNG")


def test_scenes(spark, tmp_path):
    a = np.arange(24).reshape(2, 3, 4).astype("int16")
    a[0, 0, 0] = -9
    (tmp_path / "one.tif").write_bytes(tiff.encode(a, (30.0, 0, 0, 0, -30.0, 90.0), 4326, -9))
    (tmp_path / "two.TIFF").write_bytes(tiff.encode(a[:1]))
    (tmp_path / "note.txt").write_text("x")
    df = sources.read_raster(spark, str(tmp_path))
    assert df.count() == 36 and df.select("image_id").distinct().count() == 2
    assert df.where("v = -9").count() == 2
    masked = sources.read_raster(spark, str(tmp_path / "one.tif"), mask_nodata=True)
    assert masked.where("v is null").count() == 1
    assert {r.v for r in sources.read_band(spark, str(tmp_path / "one.tif"), 2).collect()} == {float(v) for v in a[1].ravel()}
    meta = {r.image_id.rsplit("/", 1)[1]: r for r in sources.describe(spark, str(tmp_path)).collect()}
    assert meta["one.tif"].epsg == 4326 and meta["one.tif"]["count"] == 2 and meta["two.TIFF"].epsg is None and meta["one.tif"].affine[0] == 30.0
    with pytest.raises(FileNotFoundError):
        sources.read_raster(spark, str(tmp_path / "none.tif"))
    with pytest.raises(ValueError):
        sources.read_raster(spark, str(tmp_path), [0])
    sources.write_bands(masked, str(tmp_path / "bands"))
    assert spark.read.parquet(str(tmp_path / "bands")).where("band = 2").count() == 12
    files = sources.to_tiff(masked, "int16", nodata=-9, epsg=4326).where("band = 1").first()
    b, info = tiff.decode(bytes(files.content))
    assert (b[0] == a[0]).all() and info["nodata"] == -9


def test_png(spark):
    rows = [("a", y, x, y * 10 + x) for y in range(3) for x in range(4)]
    got = bytes(sources.to_png(spark.createDataFrame(rows, "image_id string, y int, x int, v int")).first().content)
    at = got.index(b"IDAT")
    raw = zlib.decompress(got[at + 4 : got.index(b"IEND") - 8])
    assert got[:8] == b"\x89PNG\r\n\x1a\n" and raw[1:5] == bytes([0, 1, 2, 3])


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0, x, float(x)) for x in range(5)], "image_id string, band int, y int, x int, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = streaming.applied(streaming.pixel_stream(spark, str(tmp_path / "in")), pt.to_byte(F.col("v") * 100))
    streaming.each_scene(stream, lambda b: b.groupBy("image_id").agg(F.max("v").alias("m")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().m == 255


def test_scenes_written_as_files(spark, tmp_path):
    a = np.arange(12).reshape(3, 4)
    px = spark.createDataFrame([("s/one", b, y, x, float(a[y, x] + b)) for b in (1, 2) for y in range(3) for x in range(4)], "image_id string, band int, y int, x int, v double")
    files = sources.to_tiff(px, "int16", epsg=4326).withColumn("image_id", F.concat_ws("_b", "image_id", "band"))
    names = raster.write_scenes(files, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one_b1.tif", "one_b2.tif"] and len(names) == 2
    back = sources.read_raster(spark, f"{tmp_path}/out")
    assert back.count() == 24 and back.where("image_id like '%b2.tif' and y = 2 and x = 3").first().v == 13.0


def test_images_of_any_kind(spark, tmp_path):
    gray, colour = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20, np.arange(36, dtype=np.uint8).reshape(3, 4, 3) * 7
    (tmp_path / "g.png").write_bytes(tiff.png(gray))
    (tmp_path / "c.png").write_bytes(tiff.png(colour))
    got = {(r.image_id.rsplit("/", 1)[1], r.band, r.y, r.x): r.v for r in sources.read_images(spark, str(tmp_path)).collect()}
    assert len(got) == 12 + 36 and all(got["g.png", 1, y, x] == gray[y, x] for y in range(3) for x in range(4))
    assert all(got["c.png", b + 1, y, x] == colour[y, x, b] for b in range(3) for y in range(3) for x in range(4))
    (tmp_path / "no.png").write_bytes(b"text")
    with pytest.raises(Exception, match="no image"):
        sources.read_images(spark, str(tmp_path)).count()


def test_a_band_has_a_value_a_position(spark):
    df = spark.createDataFrame([("a", 1, 0, 0, 5)], "image_id string, band int, y int, x int, v int")
    with pytest.raises(ValueError):
        sources.as_band(df)
    with pytest.raises(ValueError):
        sources.as_band(df.drop("band", "x"))
    assert sources.as_band(df.drop("band")).first().v == 5.0
    with pytest.raises(ValueError):
        pt.index_image("v", "jet")
    assert df.select(pt.index_image(F.col("v") - 5, "veg").alias("c")).first().c == (230, 220, 120)


def test_extracted_bands_keep_the_profile(spark, tmp_path):
    a = np.arange(24).reshape(2, 3, 4).astype("int16")
    a[0, 0, 0] = -9
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.tif").write_bytes(tiff.encode(a, (30.0, 0, 7.0, 0, -30.0, 90.0), 32630, -9))
    px = sources.read_raster(spark, str(tmp_path / "in"), mask_nodata=True)
    names = sources.extract_bands(px, f"file://{tmp_path}/out", "int16", sources.describe(spark, str(tmp_path / "in")))
    assert sorted(n.split("/out/")[1] for n in names) == [f"one.tif/band_0{b}.{k}" for b in (1, 2) for k in ("png", "tif")]
    back, info = tiff.decode((tmp_path / "out/one.tif/band_01.tif").read_bytes())
    assert (back[0] == a[0]).all() and info["nodata"] == -9 and info["epsg"] == 32630 and info["affine"] == (30.0, 0.0, 7.0, 0.0, -30.0, 90.0)
    shown = {(r.y, r.x): r.v for r in sources.read_images(spark, f"{tmp_path}/out/one.tif/band_02.png").collect()}
    assert shown[0, 0] == 0 and shown[2, 3] >= 254 and len(shown) == 12


def test_shaded(spark):
    df = spark.createDataFrame([("a", 0, x, v) for x, v in enumerate([10.0, 20.0, 30.0, None])], "image_id string, y int, x int, v double")
    assert [r.v for r in sources.shaded(df).orderBy("x").collect()][::3] == [0, 0] and sources.shaded(df, 10, 20).where("x = 2").first().v == 255
    assert sources.shaded(df, 10, 30, pt.RAMP).where("x = 1").select("r", "g", "b").first() == pt.RAMP[1][1]
