"""Files written by many tasks, and all exports of a run in one call."""

import re

import pytest
from pyspark.sql import functions as F

from sheetspark.plans import files, views
from sheetspark.sinks import parts
from sheetspark.sources import gdsii
from test_files import M1, M2, TECHNOLOGY, box, document, folder, transistors  # noqa: F401

HIGH = TECHNOLOGY.replace('conductor "M1" {\n', 'conductor "M1" {\n height 1.0\n thickness 0.5\n').replace('conductor "M2" {\n', 'conductor "M2" {\n height 2.0\n thickness 0.5\n')


def names(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def numbers(text, name):
    body = re.search(rf'Name="{name}"[^>]*>\n(.*?)</DataArray>', text, re.S).group(1)
    return [float(v) for v in body.split()]


def test_files_are_replaced_whole(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(f"a/{k}.txt", f"text {k}".encode()) for k in range(n)], parts.FILE).repartition(3)
    parts.write_files(rows(5), str(tmp_path / "out"))
    assert names(tmp_path / "out") == [f"a/{k}.txt" for k in range(5)] and (tmp_path / "out/a/3.txt").read_text() == "text 3"
    parts.write_files(rows(2), f"file://{tmp_path}/out")
    assert names(tmp_path / "out") == ["a/0.txt", "a/1.txt"]
    parts.write_files(rows(1).where("false"), str(tmp_path / "out"))
    assert names(tmp_path / "out") == []


def quads(spark, n):
    p = lambda x, y: F.struct((F.col("id") * 1.0 + x).alias("x"), F.lit(y * 1.0).alias("y"), F.lit(0.0).alias("z"), ((F.col("id") + x) * 0.5).alias("u"))
    ring = F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1))
    return spark.range(n).select(F.when(F.col("id") < 3, "s_few").otherwise("s_most").alias("mesh"), F.lit("s").alias("whole"), F.lit("quad").alias("kind"), ring.alias("points"), F.when(F.col("id") != 4, F.col("id") * 1.0).alias("v"))


def test_grids_in_pieces(spark, tmp_path):
    parts.write_files(parts.vtu_files(quads(spark, 23), ["v"], per=4), str(tmp_path))
    grids = [n for n in names(tmp_path) if n.endswith(".vtu")]
    assert [n for n in names(tmp_path) if n.endswith(".pvtu")] == ["s.pvtu", "s_few.pvtu", "s_most.pvtu"]
    listed = lambda n: re.findall(r'Source="([^"]+)"', (tmp_path / n).read_text())
    assert sorted(listed("s.pvtu")) == grids and sorted(listed("s_few.pvtu") + listed("s_most.pvtu")) == grids
    texts = {n: (tmp_path / n).read_text() for n in grids}
    got = {}
    for text in texts.values():
        cells, points = (int(re.search(rf'NumberOf{k}="(\d+)"', text).group(1)) for k in ("Cells", "Points"))
        assert cells <= 4 and points == len(numbers(text, "potential_V")) < 4 * max(cells, 2)
        xyz, nodes, values = numbers(text, "Points"), numbers(text, "connectivity"), numbers(text, "v")
        for k, v in enumerate(values):
            got[xyz[3 * int(nodes[4 * k])]] = v
    assert len(got) == 23 and all(v == x or (x == 4 and v != v) for x, v in got.items())
    # the same rows make the same files
    parts.write_files(parts.vtu_files(quads(spark, 23).repartition(5), ["v"], per=4), str(tmp_path))
    assert {n: (tmp_path / n).read_text() for n in grids} == texts


def test_layout_streams_in_pieces(spark, tmp_path):
    p = lambda x, y: F.struct(((F.col("id") + x) * 1e-6).alias("x"), F.lit(y * 1e-6).alias("y"))
    ring = F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1))
    polygons = spark.range(11).select(F.lit("m").alias("file"), F.concat(F.lit("C"), F.col("id") % 2).alias("cell"), (F.col("id") % 3).cast("int").alias("layer"), F.lit(0).alias("datatype"), ring.alias("points"))
    parts.write_files(parts.gds_files(polygons, 1e-9, per=4), str(tmp_path))
    assert names(tmp_path) == ["m_0.gds", "m_1.gds", "m_2.gds"]
    back = gdsii.read_gds(spark, str(tmp_path)).select("struct_name", "layer", F.col("xy")[0]["x"].alias("x")).collect()
    assert sorted((r.struct_name, r.layer, r.x) for r in back) == sorted((f"C{k % 2}", k % 3, k * 1000) for k in range(11))
    parts.write_files(parts.gds_files(polygons.where("false"), 1e-9), str(tmp_path))
    assert names(tmp_path) == []


def test_all_exports_of_a_run(spark, folder, tmp_path):  # noqa: F811
    root = folder(M1, M2, box(30, 20, 0, 21, 2), box(30, 20, 2, 21, 4))
    (tmp_path / "stack.ict").write_text(HIGH)
    got = files.run(spark, document("M2", cell=2), root)
    out = tmp_path / "views"
    views.write_views(got.field, str(out), z_scale=10.0)
    maps, grids = names(out / "maps"), names(out / "grids")
    want = {"potential", "current_density", "mesh", "power", "current", "resistance", "via_current"}
    assert {n.rsplit("_", 1)[0] for n in maps if n.endswith(".gds")} == want == {n[:-4] for n in maps if n.endswith(".lyp")}
    assert {n for n in grids if n.endswith(".pvtu")} == {"sheet.pvtu", "sheet_M1.pvtu", "sheet_M2.pvtu", "stack.pvtu", "stack_M1.pvtu", "stack_M2.pvtu", "stack_V1.pvtu", "stack_Terminal.pvtu"}
    cells = views.cells_of(got.field)
    n = cells.count()
    back = gdsii.read_gds(spark, str(out / "maps" / "*.gds")).where("layer between 3000 and 3999").groupBy("layer").count().collect()
    assert {r["layer"]: r["count"] for r in back} == {r["layer"]: r["count"] for r in cells.groupBy(F.when(F.col("physical") == "M1", 3000).otherwise(3001).alias("layer")).count().collect()}
    texts = {k: (out / "grids" / k).read_text() for k in grids if k.endswith(".vtu")}
    sheet = [t for k, t in texts.items() if k.startswith("sheet_")]
    assert sum(len(numbers(t, "power_W")) for t in sheet) == n
    # all the power of the sheets is in their cells
    power = {r.layer: r.power for r in got.power.collect()}
    assert sum(sum(numbers(t, "power_W")) for t in sheet) == pytest.approx(power["M1"] + power["M2"], rel=0.05)
    assert {round(min(numbers(t, "Points")[2::3]), 6) for k, t in texts.items() if k.startswith("stack_V1")} == {15.0}
    via = next(t for k, t in texts.items() if k.startswith("stack_V1"))
    assert {round(z, 6) for z in numbers(via, "Points")[2::3]} == {15.0, 20.0} and all(v > 0 for v in numbers(via, "via_current_A"))
    ends = next(t for k, t in texts.items() if k.startswith("stack_Terminal"))
    assert sorted(set(numbers(ends, "potential_V"))) == [0.0, 1.0]


def test_channels_are_exported(spark, transistors, tmp_path):  # noqa: F811
    root, doc = transistors
    (tmp_path / "stack.ict").write_text(HIGH)
    got = files.run(spark, doc(), root)
    views.write_views(got.field, str(tmp_path / "views"))
    assert any(n.startswith("channel_resistance") for n in names(tmp_path / "views/maps"))
    text = (tmp_path / "views/grids/stack_Channel/0.vtu").read_text()
    assert numbers(text, "channel_ohm") == pytest.approx([20.0] * len(numbers(text, "channel_ohm")))
    with pytest.raises(ValueError, match="two bins"):
        views.write_views(got.field, str(tmp_path / "views"), bins=1)


def test_small_files_are_made_by_many_tasks(spark):
    p = spark.range(1200).select(F.lit("f").alias("file"), F.lit("A").alias("cell"), (F.col("id") % 7).cast("int").alias("layer"), F.lit(0).alias("datatype"), F.array(*[F.struct((F.col("id") + x).cast("double").alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1))]).alias("points"))
    made = parts.gds_files(p, 1e-3, per=4).withColumn("task", F.spark_partition_id()).groupBy().agg(F.count("*"), F.countDistinct("name"), F.countDistinct("task")).first()
    assert made[0] == made[1] == 300 and made[2] == 6
