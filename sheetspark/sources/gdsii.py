"""GDSII streams: big-endian records of length, type, data type and payload."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed record types of the format.
HEADER, BGNLIB, LIBNAME, UNITS, ENDLIB = 0x00, 0x01, 0x02, 0x03, 0x04
BGNSTR, STRNAME, ENDSTR = 0x05, 0x06, 0x07
BOUNDARY, PATH, SREF, AREF, TEXT = 0x08, 0x09, 0x0A, 0x0B, 0x0C
LAYER, DATATYPE, XY, ENDEL = 0x0D, 0x0E, 0x10, 0x11
PROPATTR, PROPVALUE = 0x2B, 0x2C
KINDS = {BOUNDARY: "boundary", PATH: "path", SREF: "sref", AREF: "aref", TEXT: "text"}

ELEMENTS = "struct_ix int, struct_name string, elem_ix int, kind string, layer short, datatype short, xy array<struct<x:int,y:int>>, props array<struct<attr:short,value:string>>, dbu_user double, dbu_meters double"


def excess64(raw: bytes) -> float:
    """The format's own reals: sign, exponent of 16 in excess 64, 56 bits of mantissa."""
    n = int.from_bytes(raw, "big")
    m = n & ((1 << 56) - 1)
    return (-1.0 if n >> 63 else 1.0) * m / (1 << 56) * 16.0 ** (((n >> 56) & 0x7F) - 64)


def to_excess64(v: float) -> bytes:
    if v == 0:
        return bytes(8)
    sign, v, e = (1 << 63 if v < 0 else 0), abs(v), 64
    while v >= 1:
        v, e = v / 16, e + 1
    while v < 1 / 16:
        v, e = v * 16, e - 1
    return (sign | e << 56 | round(v * (1 << 56))).to_bytes(8, "big")


def units(raw: bytes, encoding: str = "auto") -> tuple[float, float]:
    """User and metre size of a database unit; ``auto`` takes the reading that makes a plausible length."""
    readings = {"excess64": lambda b: excess64(b), "ieee": lambda b: struct.unpack(">d", b)[0]}
    for name in ("excess64", "ieee") if encoding == "auto" else (encoding,):
        user, meters = readings[name](raw[:8]), readings[name](raw[8:16])
        if encoding != "auto" or 1e-13 < meters < 1e-5:
            return user, meters
    return readings["excess64"](raw[:8]), readings["excess64"](raw[8:16])


def records(data: bytes):
    """(type, payload); raises for lengths under 4 and payloads beyond the end."""
    at = 0
    while at + 4 <= len(data):
        n, kind = struct.unpack_from(">HB", data, at)
        if n == 0 and not any(bytes(data[at:])):
            return
        if n < 4:
            raise ValueError(f"record at {at} is shorter than its head")
        if at + n > len(data):
            raise ValueError(f"record at {at} runs over the end")
        yield kind, data[at + 4 : at + n]
        at += n


#: Bytes of elements that a task reads at a time.
PIECE = 4 << 20
#: Elements after which a task hands on what it has read.
TOGETHER = 5_000


def pieces(data: bytes, encoding: str = "auto", size: int = PIECE):
    """A library cut at the ends of its elements, about every ``size`` bytes and at each structure: (structure's number and
    name, number of the first element, user and metre size of a database unit, the elements' bytes). Only the heads of
    records are read. An open element or structure, or a missing end, is an error."""
    struct_ix, name, unit, in_struct, in_element, ended = -1, None, (None, None), False, False, False
    at = begin = first = n = 0
    for kind, payload in records(data):
        end = at + 4 + len(payload)
        if kind == UNITS:
            unit = units(payload, encoding)
        elif kind == BGNSTR:
            struct_ix, name, in_struct, first, n = struct_ix + 1, "", True, 0, 0
            begin = end
        elif kind == STRNAME:
            name = bytes(payload).rstrip(b"\0").decode("latin-1")
            begin = end
        elif kind in KINDS:
            in_element = True
        elif kind in (ENDSTR, ENDLIB):
            if n > first:
                yield struct_ix, name, first, *unit, bytes(data[begin:at])
                first = n
            in_struct = in_struct and kind != ENDSTR
            if kind == ENDLIB:
                ended = True
                break
            begin = end
        elif kind == ENDEL and in_element:
            in_element, n = False, n + 1
            if end - begin >= size:
                yield struct_ix, name, first, *unit, bytes(data[begin:end])
                begin, first = end, n
        at = end
    if in_element or in_struct:
        raise ValueError("an element or structure is still open at the end")
    if not ended:
        raise ValueError("the library has no end")


def elements(piece: tuple) -> list[tuple]:
    """The elements of one of :func:`pieces`, in order, as rows of ``ELEMENTS``."""
    struct_ix, name, n, user, meters, data = piece
    rows, elem = [], None
    for kind, p in records(data):
        if kind in KINDS:
            elem = {"kind": KINDS[kind], "layer": None, "datatype": None, "xy": [], "props": []}
        elif elem is None:
            continue
        elif kind == LAYER:
            elem["layer"] = struct.unpack(">h", p[:2])[0]
        elif kind == DATATYPE:
            elem["datatype"] = struct.unpack(">h", p[:2])[0]
        elif kind == XY:
            v = struct.unpack(f">{len(p) // 4}i", p[: len(p) // 4 * 4])
            elem["xy"] = [{"x": x, "y": y} for x, y in zip(v[::2], v[1::2])]
        elif kind == PROPATTR:
            elem["props"].append({"attr": struct.unpack(">h", p[:2])[0], "value": ""})
        elif kind == PROPVALUE:
            text = bytes(p).rstrip(b"\0").decode("latin-1")
            if elem["props"] and elem["props"][-1]["value"] == "":
                elem["props"][-1]["value"] = text
            else:
                elem["props"].append({"attr": 0, "value": text})
        elif kind == ENDEL:
            rows.append((struct_ix, name, n, elem["kind"], elem["layer"], elem["datatype"], elem["xy"], elem["props"], user, meters))
            elem, n = None, n + 1
    return rows


def parse(data: bytes, encoding: str = "auto") -> list[tuple]:
    """Elements in order, as rows of ``ELEMENTS``; errors as :func:`pieces` raises them."""
    return [r for piece in pieces(data, encoding) for r in elements(piece)]


PIECES = "source string, struct_ix int, struct_name string, first int, dbu_user double, dbu_meters double, bytes binary"


def read_gds(spark: SparkSession, path: str, encoding: str = "auto", size: int = PIECE) -> DataFrame:
    """One row for each element of the files at ``path``. A file's records are a chain, so one task walks along their heads
    and cuts it at element ends; the pieces are dealt out and their elements read by as many tasks as there are pieces. A
    file comes as one value and may have up to 2 GB."""

    def cut(frames):  # small files' pieces and elements go on together, as each table handed over has a cost of its own
        for pdf in frames:
            rows, held = [], 0
            for source, content in pdf.itertuples(index=False):
                for piece in pieces(memoryview(content), encoding, size):
                    rows.append((source, *piece))
                    held += len(piece[-1])
                    if held >= 8 * size:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    def read(frames):
        names = [c.split()[0] for c in ELEMENTS.replace("array<struct<x:int,y:int>>", "a").replace("array<struct<attr:short,value:string>>", "a").split(", ")]
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                rows += elements(tuple(r[1:]))
                if len(rows) >= TOGETHER:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    whole = spark.read.format("binaryFile").load(path).select("path", "content")
    dealt = whole.mapInPandas(cut, PIECES).repartition("source", "struct_ix", "first")
    return dealt.mapInPandas(read, ELEMENTS)


def layout(elements: DataFrame, names: DataFrame) -> DataFrame:
    """Polygons of the first structure in metres: boundaries and paths of three points or more. ``names(layer, name)``;
    a logical name that starts with net_ is the net."""
    e = elements.where("struct_ix = 0 and kind in ('boundary', 'path')").where(F.size("xy") >= 3)
    points = F.transform("xy", lambda p: F.struct((p["x"] * F.col("dbu_meters")).alias("x"), (p["y"] * F.col("dbu_meters")).alias("y")))
    joined = e.join(names, "layer", "left")
    return joined.select(F.col("elem_ix").cast("long").alias("poly_id"), "layer", "datatype", F.col("name").alias("logical"), F.when(F.col("name").startswith("net_"), F.col("name")).alias("net"), points.alias("points"), "props")
