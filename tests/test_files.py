"""Runs from files: layout, maps, technology and settings in, the report out."""

import pytest
from pyspark.sql import functions as F

from sheetspark import __main__ as cli
from sheetspark.operators import network, solve, summary
from sheetspark.plans import files
from sheetspark.sinks.files import gds_bytes

TECHNOLOGY = """process "p" {
 temp_reference 25
}
conductor "M1" {
 resistivity 1.0
}
conductor "M2" {
 resistivity 1.0 4.0 0.5 40.0
 temp_tc1 0.01
}
via "V1" {
 top_layer "M2"
 bottom_layer "M1"
 area_resistance 1.0 0.25
}
"""


def box(layer, x0, y0, x1, y1):
    return ("TOP", layer, 0, [(x * 1e-6, y * 1e-6) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def document(far, temperature=25, cell=0.5, extra=""):
    ends = "".join(f"  - name: {n}\n    voltage: {v}\n    x_um: {x}\n    y_um: 2\n    dx_um: 0.2\n    dy_um: 4\n    layer: {layer}\n" for n, v, x, layer in (("D", 1.0, 0, "M1"), ("S", 0.0, 40, far)))
    return f"project:\n  layout: top.gds\n  gds_map: gds.map\n  layer_map: layers.map\n  tech_ict: stack.ict\nmeshing:\n  sheet_cell_um: {cell}\n  sheet_cap: 200\n{extra}solver:\n  temperature_c: {temperature}\nterminals:\n{ends}"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "stack.ict").write_text(TECHNOLOGY)
    (tmp_path / "gds.map").write_text("net_M1 10 0\nnet_M2 20 0\nvia1 30 0\n")
    (tmp_path / "layers.map").write_text("conducting_layers\nnet_M1 M1\nnet_M2 M2\nvia_layers\nvia1 V1\n")

    def put(*shapes):
        (tmp_path / "top.gds").write_bytes(b"".join(gds_bytes("LIB", 1e-6, shapes)))
        return str(tmp_path)

    return put


M1, M2 = box(10, 0, 0, 40, 4), box(20, 0, 0, 40, 4)


def test_two_metals_and_vias(spark, folder):
    got = files.run(spark, document("M2"), folder(M1, M2, box(30, 20, 0, 21, 2), box(30, 20, 2, 21, 4)))
    assert got.resistance == pytest.approx(10.0625, rel=0.03)
    assert sum(r.i for r in got.currents.collect()) == pytest.approx(0, abs=1e-9)


def test_width_and_temperature_scale_the_sheet(spark, folder):
    root = folder(M1, M2)
    polygons, _ = files.inputs(spark, files.settings(document("M2", 35)), root)
    assert {r.physical: r.r_sheet for r in polygons.collect()} == pytest.approx({"M1": 1.0, "M2": 1.1})


def test_cells_of_one_layer(spark):
    rects = spark.createDataFrame([(k, p, 0, 1.0, 0.0, 0.0, 40.0, 4.0) for k, p in ((1, "M1"), (2, "M2"))], "id long, physical string, component int, r_sheet double, x0 double, y0 double, x1 double, y1 double")
    cells = network.grid_rects(summary.layer_cells(rects, {"M1": 1.0, "M2": -1.0}, 2.0), F.col("lateral"), 200)
    assert {r["physical"]: r["count"] for r in cells.groupBy("physical").count().collect()} == {"M1": 160, "M2": 40}


def test_command_line(spark, folder, tmp_path):
    folder(M1)
    (tmp_path / "run.yaml").write_text(document("M1"))
    assert cli.main([str(tmp_path / "run.yaml"), "-o", str(tmp_path / "report.txt"), "--views", str(tmp_path / "views"), "--log", "off"]) == 0
    report = (tmp_path / "report.txt").read_text()
    assert float(report.split()[1]) == pytest.approx(10, rel=0.02) and "M1" in report and "\nD" in report and "\nS" in report
    # no via, no channel and no height: the maps and grids of the sheet alone
    assert (tmp_path / "views/maps/power_0.gds").exists() and not (tmp_path / "views/maps/via_current.lyp").exists()
    assert [n.name for n in sorted((tmp_path / "views/grids").glob("*.pvtu"))] == ["sheet.pvtu", "sheet_M1.pvtu"]


def test_large_components_are_solved_across_tasks(spark):
    n = 6
    rows = [(c, c * 100 + k, c * 100 + k + 1, 1.0 + (k * 7 % 5)) for c in range(3) for k in range(n if c else 3)]
    edges = spark.createDataFrame(rows, "component int, a long, b long, g double")
    fixed = spark.createDataFrame([(0, 0, 1.0), (0, 3, 0.0), (1, 100, 1.0), (1, 100 + n, 0.0)], "component int, node long, value double")
    at = lambda df: {(r.component, r.node): r.u for r in df.collect()}
    want, got = at(solve.solve_components(edges, fixed)), at(solve.solve_by_size(edges, fixed, large=4))
    assert got == pytest.approx(want, abs=1e-6) and len(got) == len(want)


DEVTAB = """Device Entry
Mon Jan  1 00:00:00 2024
seed_nch
NMOS
nch
-
-
-
3
d net_M1
g net_M2
s net_M2
0
1
w
"""


@pytest.fixture
def transistors(tmp_path, folder):
    """Two strips of 10 squares, M1 and M2, and seeds over the ends that face each other."""
    (tmp_path / "gds.map").write_text("net_M1 10 0\nnet_M2 20 0\nvia1 30 0\nseed_nch 40 0\n")
    (tmp_path / "dev.tab").write_text(DEVTAB)
    (tmp_path / "top.spi").write_text("".join(f"XM{k} 7 9 8 0 nch w=1 $X=41 $Y={y} $D=5\n" for k, y in enumerate((1, 3))) + "XM9 7 9 8 0 nch w=1 $X=900 $Y=900\n")
    (tmp_path / "names.txt").write_text("7 D\n8 S\n9 gate\n")
    (tmp_path / "pins.txt").write_text("*.DEVTMPLT 5 nch() seed_nch rx(d) pc(g) rx(s)\n")
    (tmp_path / "ports.txt").write_text("D 7 in 0 2 D\nS 8 in 82 2 S\n")
    # 0.05 siemens at every voltage
    (tmp_path / "model.csv").write_text("Wfinger,1\n" + "".join(f"{t},{g},{v},{0.05 * v}\n" for t in (0, 100) for g in (-2, 0, 2) for v in (0, 0.5, 1)))
    root = folder(M1, box(20, 42, 0, 82, 4), *[box(40, 40, y, 42, y + 1) for y in (0.5, 2.5)])
    paths = {"devtab": "dev.tab", "spi": "top.spi", "net_names": "names.txt", "pin_xy": "pins.txt", "ports": "ports.txt", "model_csv": "model.csv"}

    def doc(leave=(), **solver):
        own = "".join(f"  {k}: {v}\n" for k, v in paths.items() if k not in leave)
        base = document("M2").replace("x_um: 40", "x_um: 82").replace("meshing:", f"{own}meshing:", 1)
        return base.replace("solver:\n", "solver:\n" + "".join(f"  {k}: {v}\n" for k, v in solver.items()))

    return root, doc


def test_channels_from_files(spark, transistors):
    root, doc = transistors
    got = files.run(spark, doc(), root)
    ch = got.channels.orderBy("id").collect()
    assert [c.instance for c in ch] == ["XM0", "XM1"] and [c.r for c in ch] == pytest.approx([20.0, 20.0])
    # two strips of ten squares and two channels of 20 ohm side by side; the current crowds a little at their nodes
    assert 30.0 < got.resistance < 31.5
    assert sum(r.i for r in got.currents.collect()) == pytest.approx(0, abs=1e-9)
    assert "Channels: 2" in got.text and "channels" in got.text and "XM1" in got.text


@pytest.mark.parametrize("leave", [("pin_xy",), ("net_names",), ("spi", "net_names", "pin_xy")])
def test_roles_by_place_by_port_and_by_name(spark, transistors, leave):
    root, doc = transistors
    got = files.run(spark, doc(leave), root)
    ch = got.channels.collect()
    assert len(ch) == 2 and all(c.gate is None or leave[0] == "spi" for c in ch)
    assert {c.instance for c in ch} == ({None} if leave[0] == "spi" else {"XM0", "XM1"})
    assert got.resistance < float("inf")


def test_ports_and_models_that_are_missing(spark, transistors, tmp_path):
    root, doc = transistors
    with pytest.raises(ValueError, match="model table"):
        files.run(spark, doc(("model_csv",)), root)
    assert files.run(spark, doc(("model_csv",), missing_model="open"), root).resistance > 1e9  # no current but rounding
    (tmp_path / "ports.txt").write_text("D 7 in 0 2 D\nBULK 1 in 0 2 B\n")
    with pytest.raises(ValueError, match="BULK"):
        files.run(spark, doc(), root)
