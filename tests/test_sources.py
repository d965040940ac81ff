"""Parsers with their diagnostics, GDSII round trips, settings and writers."""

import struct

import pytest
from pyspark.sql import functions as F

from sheetspark.sinks import files
from sheetspark.sources import config, gdsii, text


def lines(spark, body):
    return spark.createDataFrame([("f", i + 1, s) for i, s in enumerate(body.split("\n"))], "source string, line long, value string")


def test_layer_numbers(spark):
    data, diags = text.layer_numbers(lines(spark, "net_M1 10 0\nnet_M2 20 0\nheader line of many words\nnet_X 10 0\nbad ten 0"))
    assert {(r.layer, r.name) for r in data.collect()} == {(10, "net_X"), (20, "net_M2")}
    assert [r.line for r in diags.collect()] == [5]


def test_layer_map(spark):
    data, diags = text.layer_map(lines(spark, "early M0\nconducting_layers\nnet_M1 M1 # note\nvia_layers\nvia1 V1\nshort"))
    assert {tuple(r) for r in data.collect()} == {("net_M1", "M1", "conducting"), ("via1", "V1", "via")}
    assert sorted(r.line for r in diags.collect()) == [1, 6]


def test_ports(spark):
    data, diags = text.ports(lines(spark, "D 1 out 1000 2000 net_M1\nS x in 0 2000 net_M1\nbad 1 in x y z\n# comment"), 1e-9)
    assert {(r.name, r.id, round(r.x * 1e6, 6)) for r in data.collect()} == {("D", 1, 1.0), ("S", None, 0.0)}
    assert diags.count() == 1


def test_net_names(spark):
    data, _ = text.net_names(lines(spark, "% head\n1 D\n2 S\n* x\n3 G"))
    assert {tuple(r) for r in data.collect()} == {(1, "D"), (2, "S"), (3, "G")}


def test_spice_instances(spark):
    data, diags = text.spice_instances(lines(spark, "X0 1 2 3 nch w=2e-6 nf=4 $X=100 $Y=200 $D=202\nXX_skip 1 2 m\nX1 1 2\nR1 1 2 5"))
    r = data.first()
    assert (r.name, r.nodes, r.model, r.params["w"], r.x, r.y, r.d) == ("X0", ["1", "2", "3"], "nch", 2e-6, 100.0, 200.0, "202")
    assert data.count() == 1 and diags.count() == 1


def test_device_templates(spark):
    r = text.device_templates(lines(spark, "*.DEVTMPLT 202 nch() seed_n rx(d) pc(g) rx(s)"))[0].first()
    assert (r.id, r.model, r.seed) == (202, "nch", "seed_n") and [(t.term, t.layer) for t in r.terminals] == [("d", "rx"), ("g", "pc"), ("s", "rx")]


def test_device_table(spark):
    body = "Device Entry\n2024\nnch\nNMOS\n(null)\nr1\nr2\nr3\n2\nd rx\ng pc\n1\nprop\n1\nw"
    data, diags = text.device_table(lines(spark, body))
    r = data.first()
    assert (r.name, r.kind, r.model, [t.name for t in r.terminals], r.property_layers, r.params) == ("nch", "NMOS", None, ["d", "g"], ["prop"], ["w"])
    assert text.device_table(lines(spark, "Device Entry\nx"))[1].count() == 1


def test_model_table(spark):
    data, ref, diags = text.model_table(lines(spark, "L,4e-7\nWfinger,2e-6\nT,Vgs,Vds,Id\n27,-2,0.1,1e-2\n27,-2,0.1,3e-2\n27,0,0.1,1e-9\n27,1,x,2"))
    assert {tuple(r) for r in data.collect()} == {(27.0, -2.0, 0.1, 3e-2), (27.0, 0.0, 0.1, 1e-9)}
    assert tuple(ref.first()) == (4e-7, 2e-6) and [r.line for r in diags.collect()] == [7]


def test_technology(spark):
    body = 'process "p" {\n temp 25\n}\nconductor "M1" {\n resistivity 1 2 3 4 # pairs\n resistivity 9\n}\nstray 1\nodd "x" {\n}\nvia "v" {\n top M2'
    data, diags = text.technology(lines(spark, body))
    got = {(r.kind, r.name): r.fields for r in data.collect()}
    assert got == {("process", "p"): {"temp": "25"}, ("conductor", "M1"): {"resistivity": "1 2 3 4"}}
    assert {r.message for r in diags.collect()} == {"field outside a block", "unknown kind of block", "block is not closed"}


@pytest.mark.parametrize("encoding", ["excess64", "ieee"])
def test_gds_round_trip(spark, tmp_path, encoding):
    rows = [("TOP", 0, 10, 0, [(0.0, 0.0), (4e-6, 0.0), (4e-6, 2e-6), (0.0, 2e-6)]), ("TOP", 1, 20, 5, [(-1e-6, 0.0), (1e-6, 0.0), (0.0, 1e-6)]), ("TOP", 2, 1, 1, [(0.0, 0.0)])]
    df = spark.createDataFrame(rows, "cell string, ord int, layer int, datatype int, points array<struct<x:double,y:double>>")
    path = str(tmp_path / "a.gds")
    files.write_gds(df, path, encoding=encoding)
    back = gdsii.read_gds(spark, path).orderBy("elem_ix").collect()
    assert [(r.layer, r.datatype, len(r.xy), r.struct_name) for r in back] == [(10, 0, 5, "TOP"), (20, 5, 4, "TOP")]
    assert back[0].dbu_meters == pytest.approx(1e-9) and (back[1].xy[0].x, back[1].xy[0].y) == (-1000, 0)
    names = spark.createDataFrame([(10, "net_M1"), (20, "mark")], "layer short, name string")
    got = {r.layer: (r.net, round(r.points[1].x * 1e6, 6)) for r in gdsii.layout(gdsii.read_gds(spark, path), names).collect()}
    assert got == {10: ("net_M1", 4.0), 20: (None, 1.0)}


def test_gds_errors_and_reals():
    for bad in (b"\x00\x02\x00\x00", struct.pack(">HBB", 40, 0, 2), struct.pack(">HBB", 4, gdsii.BGNSTR, 0)):
        with pytest.raises(ValueError):
            gdsii.parse(bad)
    for v in (1e-9, 1e-3, -2.5, 0.0, 1.0):
        assert gdsii.excess64(gdsii.to_excess64(v)) == pytest.approx(v, rel=1e-14)


def test_settings():
    s = config.settings('project:\n  layout: "a.gds" # note\n  temperature_c: 27\nmeshing:\n  cell_um: 1.5\n  per_layer_cell_um: {}\nterminals:\n  - name: D\n    voltage: 1\n  - name: S\n    voltage: 0\n')
    assert s.meshing.cell_um == 1.5 and s.meshing.max_cells == 30 and s.temperature_c == 27 and [t["name"] for t in s.terminals] == ["D", "S"]
    assert config.layer_overrides("Poly1 0.5\nMetal3 1.0 # x\nM0 -1\n") == {"Poly1": 0.5, "Metal3": 1.0}
    with pytest.raises(ValueError):
        config.settings("solver:\n  missing_model: maybe\n")


def test_vtu_and_layer_properties():
    out = files.vtu([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [("quad", [0, 1, 2, 3]), ("triangle", [0, 1, 2])], {"u": [0, 1, 2, 3]}, {"p": [1, 2]})
    assert 'NumberOfCells="2"' in out and ">\n9 5\n<" in out
    with pytest.raises(ValueError):
        files.vtu([(0, 0, 0)], [], {"u": [1, 2]}, {})
    assert files.layer_properties([("a<b", 100, 0)], 8).count("<group-members>") == 8


def test_subset_renumbers_points(spark):
    cells = spark.createDataFrame([(1, [5, 6, 7]), (2, [7, 8, 9]), (3, [9, 5, 6])], "id long, nodes array<long>")
    new, points = files.subset_cells(cells, spark.createDataFrame([(2,), (3,)], "id long"))
    assert {r.id: r.nodes for r in new.collect()} == {2: [0, 1, 2], 3: [2, 3, 4]} and points.count() == 5


def test_a_stream_is_read_by_pieces_like_as_a_whole(spark, tmp_path):
    polygons = [(f"cell{c}", c * 7 + k, c % 3, [(0.0, 0.0), (1e-6 * (k + 1), 0.0), (1e-6, 2e-6), (0.0, 3e-6)]) for c in range(9) for k in range(1 + 40 * (c == 4))]
    data = b"".join(files.gds_bytes("LIB", 1e-9, polygons + [("empty", 0, 0, [])]))
    for name in ("a.gds", "b.gds"):
        (tmp_path / name).write_bytes(data)
    whole = gdsii.parse(data)
    for size in (1, 300, 1 << 20):
        cut = list(gdsii.pieces(data, size=size))
        assert [r for p in cut for r in gdsii.elements(p)] == whole and len(whole) == 49
        assert len(cut) == {1: 49, 300: len(cut), 1 << 20: 9}[size]
        out = gdsii.read_gds(spark, str(tmp_path), size=size)
        key = lambda r: (r[0], r[1], r[2], r[3], r[4], r[5], tuple((p["x"], p["y"]) for p in r[6]))
        assert sorted(map(key, out.collect())) == sorted(2 * [key(r) for r in whole])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert gdsii.read_gds(spark, str(tmp_path), size=1).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pieces_refuse_what_is_left_open():
    data = b"".join(files.gds_bytes("LIB", 1e-9, [("c", 1, 0, [(0.0, 0.0), (1e-6, 0.0), (1e-6, 1e-6)])]))
    ends = [data[:-4], data[:-8], data[: data.index(struct.pack(">HBB", 4, gdsii.ENDEL, 0))] + data[-4:], data[:-2]]
    for bad in ends:
        with pytest.raises(ValueError):
            list(gdsii.pieces(bad))
