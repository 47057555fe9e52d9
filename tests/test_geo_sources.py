"""GeoTIFF, KML, projections, stitched outlines, certificates in datasets, and merging of many."""

import struct
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators import geometry, provenance, standard
from emberframe.plans import layer_queries, source_queries
from emberframe.sources import geotiff, kml


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widths left one code early."""
    bits, table, width, now = [], {bytes([i]): i for i in range(256)}, 9, b""
    put = lambda code: bits.extend((code >> k) & 1 for k in range(width - 1, -1, -1))
    put(256)
    size = 258
    for byte in data:
        if now + bytes([byte]) in table:
            now += bytes([byte])
            continue
        put(table[now])
        table[now + bytes([byte])] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        now = bytes([byte])
    put(table[now])
    put(257)
    bits += [0] * (-len(bits) % 8)
    return np.packbits(bits).tobytes()


def tiled(a: np.ndarray, order: str, compression: int, pack) -> bytes:
    """A TIFF of 16 x 16 tiles in either byte order, with a tie point."""
    h, w = a.shape
    tiles = []
    for r in range(0, h, 16):
        for c in range(0, w, 16):
            t = np.zeros((16, 16), a.dtype.newbyteorder(order))
            part = a[r : r + 16, c : c + 16]
            t[: part.shape[0], : part.shape[1]] = part
            tiles.append(pack(t.tobytes()))
    n = len(tiles)
    fields = [(256, 3, (w,)), (257, 3, (h,)), (258, 3, (a.dtype.itemsize * 8,)), (259, 3, (compression,)), (277, 3, (1,)), (322, 3, (16,)), (323, 3, (16,)), (324, 4, None), (325, 4, tuple(map(len, tiles))), (339, 3, (2,)), (33550, 12, (2.0, 3.0, 0.0)), (33922, 12, (1.0, 1.0, 0.0, 10.0, 20.0, 0.0))]
    code = {3: "H", 4: "I", 12: "d"}
    size = {3: 2, 4: 4, 12: 8}
    extra_at = 8 + 2 + 12 * len(fields) + 4
    long = sum(size[t] * (n if v is None else len(v)) for _, t, v in fields if size[t] * (n if v is None else len(v)) > 4)
    starts = tuple(extra_at + long + sum(map(len, tiles[:i])) for i in range(n))
    head, extra = struct.pack(f"{order}2sHIH", b"II" if order == "<" else b"MM", 42, 8, len(fields)), b""
    for tag, kind, v in fields:
        v = starts if v is None else v
        raw = struct.pack(f"{order}{len(v)}{code[kind]}", *v)
        head += struct.pack(f"{order}HHI", tag, kind, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", extra_at + len(extra)))
        extra += raw if len(raw) > 4 else b""
    return head + b"\0" * 4 + extra + b"".join(tiles)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("compression", "pack"), [(1, bytes), (5, lzw), (32773, lambda d: b"".join(bytes([len(d[i : i + 100]) - 1]) + d[i : i + 100] for i in range(0, len(d), 100)))])
def test_tiles_in_every_packing(order, compression, pack):
    a = np.random.default_rng(3).integers(-5, 5, (37, 50)).astype("i2")
    t = geotiff.Tiff(tiled(a, order, compression, pack))
    assert np.array_equal(np.concatenate([b for _, b in t.rows()]), a)
    assert t.placing() == (8.0, 2.0, 23.0, -3.0) and t.epsg() is None and t.nodata() is None


def test_long_lzw_and_runs():
    data = np.random.default_rng(1).integers(0, 4, 60_000).astype("u1").tobytes() + b"a" * 10_000
    assert geotiff.unpack_lzw(lzw(data)) == data
    assert geotiff.unpack_bits(bytes([254, 7, 128, 1, 8, 9])) == bytes([7, 7, 7, 8, 9])


@pytest.mark.parametrize("dtype", ["u1", "u2", "i4", "f4", "f8"])
def test_strips_round_trip(spark, tmp_path, dtype):
    a = (np.arange(70 * 31).reshape(70, 31) % 200).astype(dtype)
    (tmp_path / "a.tif").write_bytes(geotiff.encode(a, -120, 0.5, 40, -0.25, 4326, 9, compress=dtype != "f4", rows_per_strip=16))
    rows = geotiff.read_geotiff(spark, f"file://{tmp_path}")
    got = geotiff.grid(rows).orderBy("row", "col").toPandas()
    assert np.array_equal(got.value.fillna(9).to_numpy().reshape(70, 31), a.astype(float)) and got.value.isna().sum() == (a == 9).sum()
    assert (got.x.iloc[1], got.y.iloc[31]) == (-119.5, 39.75)
    assert tuple(geotiff.file_info(rows).first())[1:] == (4326, 31, 70, 9.0)
    box = geotiff.grid(geotiff.window(rows, -118, 30, -116, 39), fill=-1).toPandas()
    assert len(box) == 4 * 36 and box.x.min() == -118 and box.y.max() == 39 and box.value.iloc[0] == a[4, 4]
    assert geotiff.window(rows, 0, 0, 1, 1).count() == 0


def test_bad_files_say_why():
    with pytest.raises(ValueError, match="not a TIFF"):
        geotiff.Tiff(b"PK..")


def test_albers_there_and_back(spark):
    p = spark.range(400).select((F.col("id") % 20 * 3.0 - 125).alias("lon"), (F.col("id") / 20).cast("int").alias("k")).withColumn("lat", F.col("k") * 1.3 + 24)
    x, y = geometry.project(F.col("lon"), F.col("lat"))
    lon, lat = geometry.unproject(F.col("x"), F.col("y"))
    off = p.withColumns({"x": x, "y": y}).select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(off) < 2e-8  # two millimetres: the series ends at the sixth power
    low = geometry.projected_bounds(-100, 35, -92, 40)
    corner = spark.range(1).select(*geometry.project(F.lit(-100.0), F.lit(35.0))).first()
    assert low[0] <= corner[0] and low[1] <= corner[1]
    with pytest.raises(ValueError, match="Albers"):
        geometry.unproject(F.lit(0.0), F.lit(0.0), "EPSG:6933")


def test_outlines_of_a_ring_and_of_touching_corners(spark, sf_dir):
    disc = {r.grid_id: r for r in geometry.filled_rings(layer_queries.rings_grid(spark, sf_dir).where("grid_id = 1"), 1.0).groupBy("grid_id").agg(F.count("*").alias("n"), F.count_if("hole").alias("holes")).collect()}
    assert disc[1].n == 2 and disc[1].holes == 1
    square = lambda x, y: [{"x": float(x), "y": float(y)}, {"x": x + 1.0, "y": float(y)}, {"x": x + 1.0, "y": y + 1.0}, {"x": float(x), "y": y + 1.0}]
    pieces = [(7, square(0, 0)), (7, square(1, 0)), (7, square(2, 1)), (8, square(5, 5)[::-1])]
    df = spark.createDataFrame(pieces, "grid_id long, ring array<struct<x:double,y:double>>")
    got = geometry.stitched_rings(df).withColumn("a", geometry.ring_signed_area(F.col("ring"))).collect()
    assert sorted((r.grid_id, round(r.a, 9), r.hole) for r in got) == [(7, 1.0, False), (7, 2.0, False), (8, 1.0, False)]


def test_rasters_of_different_shapes_do_not_meet(spark):
    g = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, float("nan"))], "grid_id int, row int, col int, value double")
    rows = sorted(map(tuple, geometry.joined_grids(g, g.withColumn("value", F.col("value") + 1)).collect()))
    assert rows == [(1, 0, 0, 2.0, 3.0), (1, 0, 1, None, None)]
    with pytest.raises(Exception, match="different shapes"):
        geometry.joined_grids(g, g.where("col = 0")).collect()


def test_kml_without_polygons_and_with_heights(spark, tmp_path):
    text = """<kml><Document><Placemark><name>p</name><Point><coordinates>1,2</coordinates></Point></Placemark><Placemark><name>q</name><Polygon><outerBoundaryIs><LinearRing>
    <coordinates>
      0,0,5 1,0,5
      1,1,5 0,0,5
    </coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"""
    (tmp_path / "a.kml").write_text(text)
    got = kml.read_kml(spark, f"file://{tmp_path}/a.kml").collect()
    assert [(r.name, r.part, r.hole, [tuple(p) for p in r.ring]) for r in got] == [("q", 0, False, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])]


def test_merge_all_is_the_fold(spark, sf_dir):
    files = source_queries._files(spark, "/root/testdata/sf0.01")
    ids = sorted(r.file_id for r in files.select("file_id").distinct().collect())[:4]
    some = [files.where(F.col("file_id") == k) for k in ids]
    text = lambda df: sorted(map(str, df.select("path", "kind", "dtype", "shape", F.array_sort(F.map_entries("attrs"))).collect()))
    assert text(standard.merge_all(some)) == text(reduce(standard.merge_two, some))
    with pytest.raises(ValueError, match="conflicts"):
        standard.merge_all([some[0], some[0], some[1]])
    with pytest.raises(ValueError, match="nothing"):
        standard.merge_all([])


def test_certificates_follow_the_dataset(spark, sf_dir):
    files = source_queries._files(spark, "/root/testdata/sf0.01").where("file_id in ('f1', 'f2')")
    held = provenance.add_certificate(files, "benchmark-run-internal", "k", "me", "2024-01-01T00:00:00Z")
    assert provenance.catalog_digest(held).exceptAll(provenance.catalog_digest(files)).count() == 0
    gone = held.where("not (file_id = 'f2' and path like '/points/%')")
    assert {r.file_id: (r.valid, r.reason) for r in provenance.check_certificates(gone).collect()} == {"f1": (True, ""), "f2": (False, "digest differs")}
    assert provenance.check_certificates(files).count() == 0
    assert {r.level for r in provenance.file_levels(files).collect()} == {"VL-C"}


def test_scratch_needs_a_shared_folder(monkeypatch):
    from emberframe.session import scratch

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        scratch(Session, "x")


def test_scrambled_designs_stay_balanced(spark):
    from emberframe.operators import sensitivity

    names = {"a": (0.0, 1.0), "b": (0.0, 1.0), "c": (0.0, 1.0)}
    one, same, other = (sensitivity.saltelli(spark, 256, names, skip=0, seed=s).where("block = 'A'").orderBy("point_id").toPandas() for s in (5, 5, 6))
    assert one.equals(same) and not one.equals(other)
    for c in names:  # one point in every 256th
        assert sorted((one[c] * 256).astype(int)) == list(range(256)) == sorted((other[c] * 256).astype(int))
    assert len(set(zip((one.a * 16).astype(int), (one.b * 16).astype(int)))) == 256  # and in every square of a 16th


def big_tiled(path, blocks):
    """A sparse BigTIFF of 4.3 GB: 65536 x 65536 bytes in plain tiles of 256, zero but for ``blocks`` ((line, column) -> value)."""
    import struct

    n, tile = 1 << 16, 256
    count = (n // tile) ** 2
    head = 16 + 8 + 20 * 13 + 8
    offsets_at, sizes_at, geo_at = head, head + 8 * count, head + 16 * count
    data_at = geo_at + 200
    geo = struct.pack("<3d6d", 0.01, 0.01, 0.0, 0.0, 0.0, 0.0, -120.0, 60.0, 0.0)
    keys = struct.pack("<8H", 1, 1, 0, 1, 2048, 0, 1, 4326)
    fields = [(256, 4, 1, n), (257, 4, 1, n), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (277, 3, 1, 1), (322, 3, 1, tile), (323, 3, 1, tile), (324, 16, count, offsets_at), (325, 16, count, sizes_at), (33550, 12, 3, geo_at), (33922, 12, 6, geo_at + 24), (34735, 3, 8, geo_at + 72)]
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(fields)))
        for tag, kind, c, v in fields:
            f.write(struct.pack("<HHQQ", tag, kind, c, v))
        f.seek(offsets_at)
        f.write((data_at + tile * tile * np.arange(count, dtype="<u8")).tobytes())
        f.write(np.full(count, tile * tile, "<u8").tobytes())
        f.write(geo + keys)
        for (r, c), value in blocks.items():
            f.seek(data_at + tile * tile * (r * (n // tile) + c))
            f.write(bytes([value]) * (tile * tile))
        f.truncate(data_at + tile * tile * count)


def test_a_window_of_a_large_file_reads_its_tiles_only(spark, tmp_path, monkeypatch):
    from pyspark.sql import datasource as ds

    from emberframe.sources import files

    path = str(tmp_path / "big.tif")
    big_tiled(path, {(100, 50): 1, (100, 51): 2, (101, 50): 3, (101, 51): 4, (200, 200): 9})
    x = lambda c: -120 + 0.01 * c
    y = lambda r: 60 - 0.01 * r
    box = (x(50 * 256 + 200), y(101 * 256 + 30), x(51 * 256 + 20), y(100 * 256 + 250))
    rows = geotiff.scan_geotiff(spark, path)
    assert rows.rdd.getNumPartitions() == 65
    got = geotiff.grid(geotiff.window(rows, *box)).groupBy("value").count().collect()
    assert {r.value: r["count"] for r in got} == {1.0: 6 * 56, 2.0: 6 * 20, 3.0: 30 * 56, 4.0: 30 * 20}
    # the same reader, with its bytes counted
    read = []
    plain = files.Ranges.read
    monkeypatch.setattr(files.Ranges, "read", lambda self, at, size: read.append(size) or plain(self, at, size))
    reader = geotiff.GeoTiffReader({"path": path})
    filters = [ds.GreaterThanOrEqual(("east",), box[0]), ds.LessThanOrEqual(("west",), box[2]), ds.GreaterThanOrEqual(("north",), box[1]), ds.LessThanOrEqual(("south",), box[3])]
    assert list(reader.pushFilters(filters)) == filters
    shares = reader.partitions()
    tiles = [sum(b.num_rows for b in reader.read(s)) // 256 for s in shares]
    assert sum(tiles) == 4 and max(tiles) == 1 and sum(read) < 4 * 65536 + len(shares) * 1000


@pytest.mark.parametrize("split", [1 << 30, 2000])
def test_scan_gives_what_whole_files_give(spark, tmp_path, split):
    r = np.random.default_rng(2)
    for i, (h, w) in enumerate(((70, 31), (5, 300), (1, 1))):
        a = r.integers(0, 20, (h, w))
        (tmp_path / f"{i}.tif").write_bytes(geotiff.encode(a.astype("u2"), -120, 0.5, 40, -0.25, 4326, 9, rows_per_strip=16))
        (tmp_path / f"{i}t.tif").write_bytes(tiled(a.astype("i2"), "<", 1, bytes))
        (tmp_path / f"{i}f.tif").write_bytes(geotiff.encode(a.astype("f4"), -120, 0.5, 40, -0.25, 4326, 9, compress=False, rows_per_strip=1000))
    name = F.substring_index("grid_id", "/", -1).alias("name")
    pixels = lambda rows: {tuple(x) for x in geotiff.grid(rows).select(name, "epsg", "row", "col", "x", "y", "value").collect()}
    whole, scan = geotiff.read_geotiff(spark, f"file://{tmp_path}"), geotiff.scan_geotiff(spark, str(tmp_path), split_bytes=split)
    assert pixels(whole) == pixels(scan) and len(pixels(scan)) == 3 * (70 * 31 + 5 * 300 + 1)
    for box in ((-119.2, 30.1, -110, 39.3), (0, 0, 1, 1), (-200, -90, 200, 90), (-119.25, 39.125, -118.75, 39.875)):
        assert pixels(geotiff.window(whole, *box)) == pixels(geotiff.window(scan, *box))
    some = scan.where(F.col("row").between(20, 40) & (F.col("grid_id") == str(tmp_path / "0.tif")))
    assert pixels(some) == {p for p in pixels(scan) if 20 <= p[2] <= 40 and p[0] == "0.tif"}
    with pytest.raises(Exception, match="nothing.tif"):
        geotiff.scan_geotiff(spark, str(tmp_path / "nothing.tif")).count()
