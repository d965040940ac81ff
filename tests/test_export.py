"""Stack export and the field cache."""

from pyspark.sql import functions as F

from sheetspark.operators import export


def test_stack_and_vias(spark):
    cells = spark.createDataFrame([(1, "M1", 0.0, 0.0, 1.0, 1.0), (2, "M9", 0.0, 0.0, 1.0, 1.0)], "id long, physical string, x0 double, y0 double, x1 double, y1 double")
    heights = spark.createDataFrame([("M1", 1.0, 1.5)], "physical string, z0 double, z1 double")
    got = export.stack_cells(cells, heights).collect()
    assert [r.id for r in got] == [1] and len(got[0].points) == 8 and {p.z for p in got[0].points} == {1.0, 1.5}
    c = spark.createDataFrame([(1, "M1", 1.0, 0.5), (2, "M2", 3.0, 0.5), (3, "M3", 3.25, 0.5), (4, "M4", None, 0.5)], "ord int, name string, height double, thickness double")
    v = export.via_heights(spark.createDataFrame([("v", "M1", "M2")], "name string, bottom string, top string"), c).first()
    assert (v.z0, v.z1) == (1.5, 3.0)
    assert {(r.name, r.message) for r in export.stack_messages(c).collect()} == {("M4", "conductor has no height or thickness"), ("M3", "conductor overlaps M2")}


def test_channels_are_split(spark):
    ch = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 2.0, 2, 0)], "id long, x0 double, y0 double, x1 double, y1 double, nx int, ny int")
    got = export.channel_cells(ch, F.col("nx"), F.col("ny")).collect()
    assert sorted((r.x0, r.x1, r.y0, r.y1) for r in got) == [(0.0, 2.0, 0.0, 2.0), (2.0, 4.0, 0.0, 2.0)]


def test_cache(spark, tmp_path):
    files = [("a.gds", 10, 5)]
    key = export.fingerprint({"cell": 1.0}, files)
    assert key == export.fingerprint({"cell": 1.0}, files) != export.fingerprint({"cell": 1.0, "tol": 2}, files)
    root = f"file://{tmp_path}"
    assert export.load_fields(spark, root, key, ["nodes"]) is None
    export.save_fields({"nodes": spark.range(3)}, root, key)
    assert export.load_fields(spark, root, key, ["nodes"])["nodes"].count() == 3
