"""Text formats as DataFrames of lines: ``lines(source, line, value)`` in, tables and diagnostics out.

Every parser returns the data and a table of diagnostics (source, line, message). Lines keep their numbers, so first
and last wins are aggregates over them and nothing depends on the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their numbers within their file. A file is split by its reader as whole text, one row, so numbers
    need no global sort; technology and netlist files are small beside the layout."""
    return lines_of(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value"))


def lines_of(texts: DataFrame, column: str = "value") -> DataFrame:
    """A row for each line of ``column``, numbered from 1, with all other columns; a null text has no lines."""
    rest = [c for c in texts.columns if c != column]
    return texts.select(*rest, F.posexplode(F.split(column, "\r?\n"))).select(*rest, (F.col("pos") + 1).cast("long").alias("line"), F.col("col").alias("value"))


#: Lines that start with one of these hold no names.
COMMENT = "^[#%*]"


def names_in(lines: DataFrame) -> DataFrame:
    """A row (name) for each token of the lines that are no comments, with all other columns."""
    plain = lines.where(~F.btrim("value").rlike(COMMENT))
    return plain.withColumn("name", F.explode(F.filter(_tokens(F.col("value")), lambda t: t != ""))).drop("value")


def names_of(text: Column) -> Column:
    """The names of :func:`names_in` of one text's lines as an array of (name, line), lines numbered from 1; null for null."""
    named = lambda line, i: F.transform(F.filter(_tokens(line), lambda t: t != ""), lambda t: F.struct(t.alias("name"), (i + 1).cast("long").alias("line")))
    none = F.array().cast("array<struct<name:string,line:bigint>>")
    return F.flatten(F.transform(F.split(text, "\r?\n"), lambda line, i: F.when(~F.btrim(line).rlike(COMMENT), named(line, i)).otherwise(none)))


def _tokens(value: Column) -> Column:
    t = F.btrim(value, F.lit(" \t\r\n"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "\\s+"))


def _diag(df: DataFrame, message: Column) -> DataFrame:
    return df.select("source", "line", message.alias("message"))


def unique_diags(*tables: DataFrame) -> DataFrame:
    """All diagnostics, each (source, line, message) once."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates(["source", "line", "message"])


def layer_numbers(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(layer, name): lines of exactly three tokens name, layer, datatype; the last line of a layer wins."""
    t = lines.withColumn("t", _tokens(F.col("value"))).where(F.size("t") == 3)
    t = t.withColumns({"layer": F.col("t")[1].try_cast("short"), "datatype": F.col("t")[2].try_cast("short")})
    good = t.where("layer is not null and datatype is not null")
    data = good.groupBy("layer").agg(F.max_by(F.col("t")[0], "line").alias("name"))
    return data, _diag(t.where("layer is null or datatype is null"), F.lit("layer or datatype is not a number"))


SECTIONS = {"conducting_layers": "conducting", "via_layers": "via"}


def layer_map(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(logical, physical, role): pairs under the headings conducting_layers and via_layers; # starts a comment."""
    t = lines.withColumn("t", _tokens(F.split("value", "#")[0])).where(F.size("t") > 0)
    heading = F.when(F.col("t")[0].isin(*SECTIONS), F.element_at(F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv]), F.col("t")[0]))
    w = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("h", heading).withColumn("role", F.last("h", ignorenulls=True).over(w)).where("h is null")
    good = t.where("role is not null").where(F.size("t") >= 2).select(F.col("t")[0].alias("logical"), F.col("t")[1].alias("physical"), "role")
    bad = t.where(F.col("role").isNull() | (F.size("t") < 2))
    return good, _diag(bad, F.when(F.col("role").isNull(), "entry before any section").otherwise("entry has fewer than two names"))


def ports(lines: DataFrame, dbu: float) -> tuple[DataFrame, DataFrame]:
    """(name, id, direction, x, y, net): name, id, direction, x, y, net in database units; six tokens or more."""
    t = lines.withColumn("t", _tokens(F.split("value", "#")[0])).where(F.size("t") > 0)
    x, y = F.get("t", F.lit(3)).try_cast("double"), F.get("t", F.lit(4)).try_cast("double")
    t = t.withColumns({"x": x, "y": y})
    ok = (F.size("t") >= 6) & F.col("x").isNotNull() & F.col("y").isNotNull()
    data = t.where(ok).select(F.col("t")[0].alias("name"), F.col("t")[1].try_cast("long").alias("id"), F.col("t")[2].alias("direction"), (F.col("x") * dbu).alias("x"), (F.col("y") * dbu).alias("y"), F.col("t")[5].alias("net"))
    return data, _diag(t.where(~F.coalesce(ok, F.lit(False))), F.lit("a port needs six fields with numeric coordinates"))


def net_names(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, name); lines that start with #, % or * are comments."""
    t = lines.where(~F.btrim("value").rlike(COMMENT)).withColumn("t", _tokens(F.col("value"))).where(F.size("t") > 0)
    t = t.withColumn("id", F.col("t")[0].try_cast("long"))
    ok = F.col("id").isNotNull() & (F.size("t") >= 2)
    return t.where(ok).groupBy("id").agg(F.max_by(F.col("t")[1], "line").alias("name")), _diag(t.where(~ok), F.lit("expected a number and a name"))


def spice_instances(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, nodes, model, params, x, y, d): lines that start with X but not XX_. Nodes are the numeric tokens up to
    the first other one, the model; k=v are parameters, $X and $Y the place, $D the template."""
    t = lines.where(F.btrim("value").rlike("^X(?!X_)")).withColumn("t", _tokens(F.col("value"))).where(F.size("t") >= 3)
    rest = F.slice("t", 2, 1 << 30)
    t = t.withColumns({
        "plain": F.filter(rest, lambda s: ~s.contains("=")),
        "pairs": F.transform(F.filter(rest, lambda s: s.contains("=")), lambda s: F.struct(F.upper(F.split(s, "=", 2)[0]).alias("k"), F.split(s, "=", 2)[1].alias("v"))),
    })
    model_at = F.array_position(F.transform("plain", lambda s: s.try_cast("double").isNull()), True)
    t = t.withColumn("at", model_at)
    value = lambda k: F.get(F.filter("pairs", lambda p: p["k"] == k), F.lit(0))["v"]
    params = F.map_from_entries(F.transform(F.filter("pairs", lambda p: ~p["k"].startswith("$") & p["v"].try_cast("double").isNotNull()), lambda p: F.struct(F.lower(p["k"]), p["v"].try_cast("double"))))
    data = t.where("at > 0").select(
        F.col("t")[0].alias("name"), F.expr("slice(plain, 1, cast(at - 1 as int))").alias("nodes"), F.expr("plain[cast(at - 1 as int)]").alias("model"),
        params.alias("params"), value("$X").try_cast("double").alias("x"), value("$Y").try_cast("double").alias("y"), value("$D").alias("d"),
    )
    return data, _diag(t.where("at = 0"), F.lit("instance without a model"))


def device_templates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, model, seed, terminals): ``*.DEVTMPLT id model() seed layer(term) ...``."""
    t = lines.where(F.col("value").startswith("*.DEVTMPLT")).withColumn("t", _tokens(F.col("value")))
    t = t.withColumn("id", F.get("t", F.lit(1)).try_cast("long"))
    ok = F.col("id").isNotNull() & (F.size("t") >= 4)
    pins = F.transform(F.slice("t", 5, 1 << 30), lambda s: F.struct(F.regexp_extract(s, r"\(([^)]*)\)", 1).alias("term"), F.regexp_extract(s, r"^([^(]*)\(", 1).alias("layer")))
    return t.where(ok).select("id", F.regexp_replace(F.col("t")[2], r"\(.*\)$", "").alias("model"), F.col("t")[3].alias("seed"), pins.alias("terminals")), _diag(t.where(~ok), F.lit("template needs an id, a model and a seed layer"))


def device_table(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, kind, model, terminals, property_layers, params): entries over several lines. An entry starts at a line
    ``Device Entry``; a time stamp follows, then name, kind, model, three reserved lines, and three counted lists."""
    t = lines.withColumn("v", F.btrim("value")).where("v <> ''")
    start = F.col("v").startswith("Device Entry")
    w = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("entry", F.sum(start.cast("long")).over(w)).where("entry > 0")
    e = t.groupBy("source", "entry").agg(F.min("line").alias("line"), F.sort_array(F.collect_list(F.struct("line", "v"))).alias("rows"))
    e = e.withColumn("b", F.transform("rows", lambda r: r["v"]))
    n = lambda at: F.get("b", at).try_cast("int")
    take = lambda at, k: F.when(k > 0, F.slice("b", at + 2, k)).otherwise(F.array().cast("array<string>"))
    e = e.withColumn("n1", n(F.lit(8))).withColumn("n2", n(F.lit(9) + F.coalesce("n1", F.lit(0)))).withColumn("n3", n(F.lit(10) + F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))))
    ok = F.col("n1").isNotNull() & F.col("n2").isNotNull() & F.col("n3").isNotNull() & (F.size("b") >= 11 + F.col("n1") + F.col("n2") + F.col("n3"))
    pins = F.transform(take(F.lit(8), F.col("n1")), lambda s: F.struct(F.split(s, "\\s+")[0].alias("name"), F.get(F.split(s, "\\s+"), F.lit(1)).alias("layer")))
    data = e.where(ok).select(
        F.col("b")[2].alias("name"), F.col("b")[3].alias("kind"), F.when(F.col("b")[4] != "(null)", F.col("b")[4]).alias("model"),
        pins.alias("terminals"), take(F.lit(9) + F.col("n1"), F.col("n2")).alias("property_layers"), take(F.lit(10) + F.col("n1") + F.col("n2"), F.col("n3")).alias("params"),
    )
    return data, _diag(e.where(~F.coalesce(ok, F.lit(False))), F.lit("malformed device entry"))


#: Fixed heading names of the model table.
MODEL_SKIP = ("Temperature", "Vgsmax", "Model", "T")


def model_table(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(t, vgs, vds, id), (l_ref, w_ref), diagnostics: rows of four numbers; of equal points the last wins. Lengths
    default to 0.4 and 1 micrometre."""
    t = lines.withColumn("c", F.transform(F.split("value", ","), lambda s: F.btrim(s))).where(F.btrim("value") != "")
    head = F.col("c")[0]
    number = lambda i: F.get("c", F.lit(i)).try_cast("double")
    t = t.withColumns({"t": number(0), "vgs": number(1), "vds": number(2), "id": number(3)})
    row = F.col("t").isNotNull() & (F.size("c") == 4) & F.col("vgs").isNotNull() & F.col("vds").isNotNull() & F.col("id").isNotNull()
    data = t.where(row).groupBy("t", "vgs", "vds").agg(F.max_by("id", "line").alias("id"))
    ref = t.agg(F.coalesce(F.max(F.when(head == "L", number(1))), F.lit(4e-7)).alias("l_ref"), F.coalesce(F.max(F.when(head == "Wfinger", number(1))), F.lit(1e-6)).alias("w_ref"))
    heads = head.isin("L", "Wfinger", *MODEL_SKIP) | head.rlike("^[A-Za-z]")
    return data, ref, _diag(t.where(~row & ~heads), F.lit("expected four numbers"))


#: Fixed names of technology blocks.
BLOCKS = ("process", "conductor", "dielectric", "diffusion", "via")


def technology(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ord, kind, name, fields): ``kind "name" {`` ... ``}`` blocks; a field is a key and the rest of its line, of
    equal keys the first. A block that is open when another opens is dropped, as is one of unknown kind."""
    t = lines.withColumn("v", F.btrim(F.split("value", "#")[0])).where("v <> ''")
    opens, closes = F.col("v").endswith("{"), F.col("v").startswith("}")
    w = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"opens": opens, "closes": closes}).withColumn("block", F.sum(F.col("opens").cast("long")).over(w))
    ends = Window.partitionBy("source", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("shut", F.coalesce(F.max(F.col("closes").cast("int")).over(ends), F.lit(0)))
    head = t.where("opens").select("source", "block", F.col("line").alias("ord"), F.regexp_extract("v", r"^(\w+)", 1).alias("kind"), F.regexp_extract("v", r'"([^"]*)"', 1).alias("name"))
    body = t.where("block > 0 and not opens and not closes and shut = 0").withColumn("k", F.regexp_extract("v", r"^(\S+)", 1)).withColumn("f", F.btrim(F.regexp_replace("v", r"^\S+", "")))
    first = body.groupBy("source", "block", "k").agg(F.min_by("f", "line").alias("f"))
    fields = first.groupBy("source", "block").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "f")))).alias("fields"))
    closed = t.where("closes and block > 0 and shut = 0").select("source", "block").distinct()
    whole = head.join(closed, ["source", "block"]).join(fields, ["source", "block"], "left")
    known = F.col("kind").isin(*BLOCKS)
    data = whole.where(known).select("ord", "kind", "name", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"))
    d = [
        head.where(~known).select("source", F.col("ord").alias("line"), F.lit("unknown kind of block").alias("message")),
        head.join(closed, ["source", "block"], "left_anti").select("source", F.col("ord").alias("line"), F.lit("block is not closed").alias("message")),
        _diag(t.where("closes and (block = 0 or shut = 1)"), F.lit("brace closes nothing")),
        _diag(t.where("not opens and not closes and (block = 0 or shut = 1)"), F.lit("field outside a block")),
    ]
    return data, unique_diags(*d)


def numbers(text: Column, factor: float = 1.0) -> Column:
    """The numbers of a field, times ``factor`` (micrometres to metres)."""
    return F.transform(F.filter(F.split(F.btrim(text), "[\\s,]+"), lambda s: s.try_cast("double").isNotNull()), lambda s: s.cast("double") * factor)
