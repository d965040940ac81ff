"""Files of foreign formats written by many tasks: each row is one whole file, and a table of any size becomes as many
files as it has pieces, with an index of them where the format has one.

A file's name follows from the rows in it, never from the task, so an attempt that is repeated writes the same file again.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..log import LOG
from ..operators.summary import numbered
from .files import gds_bytes, vtu

#: Rows of a file; one file is made in memory by one task.
PER_FILE = 50_000
#: Files that a task makes; by their bytes alone Spark would give many small ones to one task.
FILES = 50
FILE = "name string, content binary"


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path else posixpath.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    size: int


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> Written:
        fs, root = _open(self.path)
        names, size = [], 0
        for row in iterator:
            target = f"{root}/{row['name']}"
            fs.create_dir(posixpath.dirname(target))
            with fs.open_output_stream(target) as out:
                out.write(row["content"])
            names.append(row["name"])
            size += len(row["content"])
        return Written(names, size)

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        names = {n for m in told for n in m.names}
        if self.overwrite:  # files of an earlier write that this one has no row for
            from pyarrow.fs import FileSelector, FileType

            fs, root = _open(self.path)
            for info in fs.get_file_info(FileSelector(root, allow_not_found=True, recursive=True)):
                if info.type == FileType.File and info.path[len(root) :].lstrip("/") not in names:
                    fs.delete_file(info.path)
        LOG.info("wrote %d files of %d bytes to %s", len(names), sum(m.size for m in told), self.path)

    def abort(self, messages: list[Written | None]) -> None:
        LOG.warning("writing to %s failed; it may hold some of the files", self.path)


class FileParts(DataSource):
    """``df.write.format("file_parts")`` of (name, content); names are relative to the path."""

    @classmethod
    def name(cls) -> str:
        return "file_parts"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str) -> None:
    """(name, content) as files under ``path``; whatever else lies there is removed once all are written. A name that two
    rows bear is an error of the caller: one of them stays."""
    files.sparkSession.dataSource.register(FileParts)
    files.select("name", F.col("content").cast("binary").alias("content")).write.format("file_parts").mode("overwrite").save(path)


def _dealt(rows: DataFrame, by: str, order: list[str], per: int) -> DataFrame:
    """Rows with their ``number`` and ``piece``: the runs of ``per`` rows in the order of ``by`` and ``order``, numbered from 0 for each
    value of ``by``. No piece has more than ``per`` rows, however many rows a value has. A task gets about ``FILES`` pieces."""
    own = numbered(rows, by, *order, name="number")
    first = own.groupBy(by).agg(F.min("number").alias("_first"))
    dealt = own.join(first, by).withColumn("piece", F.floor((F.col("number") - F.col("_first")) / per)).drop("_first")
    return dealt.repartition(max(1, -(-rows.count() // (per * FILES))), by, "piece")


def vtu_files(elements: DataFrame, values: list[str], per: int = PER_FILE) -> DataFrame:
    """(name, content): the meshes of elements(mesh, whole, kind, points array<struct<x,y,z,u>>, *values) as unstructured
    grids ``mesh/piece.vtu``, with an index ``mesh.pvtu`` of each mesh and one ``whole.pvtu`` of all meshes that name it.
    Points of equal place and potential are one within a piece. Null values are NaN; elements without points are left out.
    """
    kept = elements.where("size(points) > 0").withColumn("at", F.struct(F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"), F.col("points")[0]["z"].alias("z")))
    dealt = _dealt(kept.select("mesh", "whole", "kind", "points", "at", *values), "mesh", ["at", "kind", "points", *values], per)

    def piece(pdf):
        import pandas as pd

        pdf = pdf.sort_values("number")  # a group's rows come in any order
        index: dict[tuple, int] = {}
        cells = [(kind, [index.setdefault((p["x"], p["y"], p["z"], p["u"]), len(index)) for p in pts]) for kind, pts in zip(pdf["kind"], pdf["points"])]
        body = vtu([k[:3] for k in index], cells, {"potential_V": [k[3] for k in index]}, {v: [float(x) for x in pdf[v]] for v in values})
        mesh, whole, n = pdf["mesh"].iloc[0], pdf["whole"].iloc[0], pdf["piece"].iloc[0]
        return pd.DataFrame({"name": [f"{mesh}/{n}.vtu"], "mesh": [mesh], "whole": [whole], "content": [body.encode()]})

    cast = dealt.withColumns({v: F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))) for v in values})
    made = cast.groupBy("mesh", "piece").applyInPandas(piece, "name string, mesh string, whole string, content binary")
    # the names again, without making the files: an index needs no more
    named = dealt.select(F.concat("mesh", F.lit("/"), F.col("piece").cast("string"), F.lit(".vtu")).alias("name"), "mesh", "whole").distinct()
    listed = named.select("name", F.explode(F.array_distinct(F.array("mesh", "whole"))).alias("index")).groupBy("index").agg(F.sort_array(F.collect_list("name")).alias("names"))
    pieces = F.array_join(F.transform("names", lambda n: F.concat(F.lit('<Piece Source="'), n, F.lit('"/>'))), "\n")
    arrays = "\n".join(f'<PDataArray type="Float64" Name={quoteattr(v)}/>' for v in values)
    head = ('<?xml version="1.0"?>\n<VTKFile type="PUnstructuredGrid" version="0.1" byte_order="LittleEndian">\n<PUnstructuredGrid GhostLevel="0">\n'
            '<PPoints>\n<PDataArray type="Float64" Name="Points" NumberOfComponents="3"/>\n</PPoints>\n'
            f'<PPointData>\n<PDataArray type="Float64" Name="potential_V"/>\n</PPointData>\n<PCellData>\n{arrays}\n</PCellData>\n')
    index = listed.select(F.concat("index", F.lit(".pvtu")).alias("name"), F.concat(F.lit(head), pieces, F.lit("\n</PUnstructuredGrid>\n</VTKFile>\n")).cast("binary").alias("content"))
    return made.select("name", "content").unionByName(index)


def gds_files(polygons: DataFrame, dbu: float, library: str = "LIB", per: int = PER_FILE) -> DataFrame:
    """(name, content): polygons(file, cell, layer, datatype, points in metres) as layout streams ``file_piece.gds``, each a
    whole library; a cell of many polygons goes on in the next piece under its name. Rings of fewer than three points are
    left out."""
    dealt = _dealt(polygons.select("file", "cell", "layer", "datatype", "points"), "file", ["cell", "layer", "datatype", "points"], per)

    def piece(pdf):
        import pandas as pd

        pdf = pdf.sort_values("number")  # by cell; a group's rows come in any order
        rows = ((r.cell, int(r.layer), int(r.datatype), [(p["x"], p["y"]) for p in r.points]) for r in pdf.itertuples())
        return pd.DataFrame({"name": [f"{pdf['file'].iloc[0]}_{pdf['piece'].iloc[0]}.gds"], "content": [b"".join(gds_bytes(library, dbu, rows))]})

    return dealt.groupBy("file", "piece").applyInPandas(piece, FILE)
