"""File writers. Formats with one ordered stream are written from an iterator over ordered rows, never a collected
table; everything else stays Parquet."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.physics import colour_bin
from ..sources import gdsii as G

COLOURS = 32
STRIDE = 64


def _record(kind: int, dtype: int, payload: bytes = b"") -> bytes:
    return struct.pack(">HBB", 4 + len(payload), kind, dtype) + payload


def _text(kind: int, s: str) -> bytes:
    raw = s.encode("latin-1", "replace")
    return _record(kind, 6, raw + b"\0" * (len(raw) % 2))


def gds_bytes(library: str, dbu: float, polygons: Iterable[tuple[str, int, int, list[tuple[float, float]]]], encoding: str = "excess64") -> Iterable[bytes]:
    """A stream of (cell, layer, datatype, points in metres), grouped by cell: rings are closed, those of fewer than
    three points left out."""
    real = G.to_excess64 if encoding == "excess64" else lambda v: struct.pack(">d", v)
    zero = bytes(24)
    yield _record(G.HEADER, 2, struct.pack(">h", 600)) + _record(G.BGNLIB, 2, zero) + _text(G.LIBNAME, library)
    yield _record(G.UNITS, 5, real(dbu / 1e-6) + real(dbu))
    cell = None
    for name, layer, datatype, points in polygons:
        if name != cell:
            if cell is not None:
                yield _record(G.ENDSTR, 0)
            yield _record(G.BGNSTR, 2, zero) + _text(G.STRNAME, name)
            cell = name
        if len(points) < 3:
            continue
        ring = points if points[0] == points[-1] else [*points, points[0]]
        away = lambda v: int(abs(v) / dbu + 0.5) * (1 if v >= 0 else -1)
        flat = [away(c) for p in ring for c in p]
        yield _record(G.BOUNDARY, 0) + _record(G.LAYER, 2, struct.pack(">h", layer)) + _record(G.DATATYPE, 2, struct.pack(">h", datatype))
        yield _record(G.XY, 3, struct.pack(f">{len(flat)}i", *flat)) + _record(G.ENDEL, 0)
    if cell is not None:
        yield _record(G.ENDSTR, 0)
    yield _record(G.ENDLIB, 0)


def write_gds(polygons: DataFrame, path: str, library: str = "LIB", dbu: float = 1e-9, encoding: str = "excess64") -> None:
    """``polygons(cell, ord, layer, datatype, points)`` to one file, by cell and ord."""
    rows = polygons.orderBy("cell", "ord").select("cell", "layer", "datatype", "points").toLocalIterator()
    with open(path, "wb") as f:
        f.writelines(gds_bytes(library, dbu, ((r.cell, r.layer, r.datatype, [(p.x, p.y) for p in r.points]) for r in rows), encoding))


def binned(items: DataFrame, base: int, bins: int = COLOURS, group: str | None = None, stride: int | None = None) -> DataFrame:
    """Items with ``layer_no`` = base + group number x stride + bin; each group has its own range of values. Groups of
    no finite value keep their number and have no rows."""
    stride = max(bins, STRIDE) if stride is None else stride
    items = items if group else items.withColumn("_g", F.lit(0))
    g = group or "_g"
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    from pyspark.sql import Window

    spans = items.groupBy(g).agg(F.min(F.when(finite, F.col("value"))).alias("low"), F.max(F.when(finite, F.col("value"))).alias("high"))
    spans = spans.withColumn("slot", F.row_number().over(Window.orderBy(g)) - 1)  # a row for each layer of the stack
    out = items.join(F.broadcast(spans), g).withColumn("bin", colour_bin(F.col("value"), F.col("low"), F.col("high"), bins)).where("bin is not null")
    out = out.withColumn("layer_no", F.lit(base) + F.col("slot") * stride + F.col("bin"))
    return out if group else out.drop("_g")


def ramp(t: float) -> tuple[int, int, int]:
    f = lambda mid: round(255 * min(max(1.5 - abs(4 * t - mid), 0.0), 1.0))
    return f(3), f(2), f(1)


def layer_properties(groups: list[tuple[str, int, int]], bins: int = COLOURS) -> str:
    """Layer properties as XML: a group for each (name, first layer number, datatype), a member for each bin."""
    out = ['<?xml version="1.0" encoding="utf-8"?>', "<layer-properties>"]
    for name, first, datatype in groups:
        out += ["<properties>", f"<name>{escape(name)}</name>", "<source>*/*@*</source>"]
        for k in range(bins):
            r, g, b = ramp(k / max(bins - 1, 1))
            colour = f"#{r:02x}{g:02x}{b:02x}"
            out.append(f"<group-members><fill-color>{colour}</fill-color><frame-color>{colour}</frame-color><name>{escape(name)} {k}</name><source>{first + k}/{datatype}@1</source></group-members>")
        out.append("</properties>")
    return "\n".join([*out, "</layer-properties>"]) + "\n"


#: Fixed cell type numbers of the format.
VTK = {"quad": 9, "triangle": 5, "hexahedron": 12, "wedge": 13}


def vtu(points: list[tuple[float, float, float]], cells: list[tuple[str, list[int]]], point_data: dict[str, list[float]], cell_data: dict[str, list[float]]) -> str:
    """An ASCII unstructured grid; arrays of another length than what they belong to are an error."""
    for name, data, n in [*((k, v, len(points)) for k, v in point_data.items()), *((k, v, len(cells)) for k, v in cell_data.items())]:
        if len(data) != n:
            raise ValueError(f"array {name} has {len(data)} values for {n}")

    def array(kind, name, values, width=1, n=12):
        extra = f' NumberOfComponents="{width}"' if width > 1 else ""
        lines = [" ".join(values[i : i + n]) for i in range(0, len(values), n)]
        return [f'<DataArray type="{kind}" Name="{escape(name)}"{extra} format="ascii">', *lines, "</DataArray>"]

    real = lambda v: [f"{x:.9e}" for x in v]
    ends, at = [], 0
    for _, nodes in cells:
        at += len(nodes)
        ends.append(str(at))
    out = ['<?xml version="1.0"?>', '<VTKFile type="UnstructuredGrid" version="0.1" byte_order="LittleEndian">', "<UnstructuredGrid>", f'<Piece NumberOfPoints="{len(points)}" NumberOfCells="{len(cells)}">']
    out += ["<Points>", *array("Float64", "Points", real(c for p in points for c in p), 3), "</Points>", "<Cells>"]
    out += array("Int32", "connectivity", [str(i) for _, nodes in cells for i in nodes]) + array("Int32", "offsets", ends) + array("UInt8", "types", [str(VTK[k]) for k, _ in cells])
    out += ["</Cells>", "<PointData>", *(x for k, v in point_data.items() for x in array("Float64", k, real(v))), "</PointData>"]
    out += ["<CellData>", *(x for k, v in cell_data.items() for x in array("Float64", k, real(v))), "</CellData>", "</Piece>", "</UnstructuredGrid>", "</VTKFile>"]
    return "\n".join(out) + "\n"


def subset_cells(cells: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (id, nodes) of ``wanted(id)`` with points numbered anew in order of first use: (id, nodes), (point, old)."""
    from ..operators.summary import numbered

    kept = cells.join(wanted, "id", "left_semi")
    uses = kept.select("id", F.posexplode("nodes").alias("pos", "old"))
    first = uses.groupBy("old").agg(F.min(F.struct("id", "pos")).alias("f"))
    points = numbered(first, "f", name="point").select(F.col("point").cast("long"), "old")
    new = uses.join(points, "old").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "point"))), lambda s: s["point"]).alias("nodes"))
    return new, points
