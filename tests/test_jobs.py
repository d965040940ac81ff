"""The jobs: two runs over growing input, runs after a failure, odd rows, the command line, and their queries."""

import os
import re
import shutil
import subprocess
import sys
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import layout_nets, text_names
from jobs import queries as jobs
from jobs.common import config
from sheetspark.operators import closure

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TEXT = config(None, text_names.__file__)
NETS = config(None, layout_nets.__file__)


def plain_index(rows):
    """(group, name, n, n_texts, first_id, first_line), sorted."""
    n, texts, first = defaultdict(int), defaultdict(set), {}
    for k, (i, text, group) in enumerate(rows):
        for line, value in enumerate(re.split(r"\r?\n", text), 1) if text is not None else ():
            if not value.lstrip(" ")[:1] in tuple("#%*"):
                for name in re.split(r"[ \t\n\x0b\f\r]+", value):
                    if name:
                        key = (group, name)
                        n[key] += 1
                        texts[key].add(k)
                        at = (i is None, -1 if i is None else i, line)
                        first[key] = min(first.get(key, at), at)
    return sorted(((g, w, n[g, w], len(texts[g, w]), None if first[g, w][0] else first[g, w][1], first[g, w][2]) for g, w in n), key=repr)


def index_of(spark, at):
    return sorted(map(tuple, text_names.read(spark, f"{at}/index").collect()), key=repr)


def run_names(spark, at, **own):
    return text_names.run(spark, f"{at}/in", f"{at}/index", f"{at}/checkpoint", TEXT | own)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000")


def plain_rows(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_names_of_growing_input(spark, sf_dir, tmp_path):
    docs = documents(spark, sf_dir)
    docs.where("doc_id % 3 > 0").repartition(5).write.parquet(f"{tmp_path}/in")
    assert run_names(spark, tmp_path, files_per_batch=2) == 3
    assert index_of(spark, tmp_path) == plain_index(plain_rows(docs.where("doc_id % 3 > 0")))
    assert run_names(spark, tmp_path, files_per_batch=2) == 0
    docs.where("doc_id % 3 = 0").repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
    assert run_names(spark, tmp_path) == 1
    both = index_of(spark, tmp_path)
    assert both == plain_index(plain_rows(docs))
    # only the new batch was written, and nothing changes once all is taken
    kept = {f: os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(f"{tmp_path}/index") for f in names if f.endswith("parquet")}
    assert run_names(spark, tmp_path) == 0 and index_of(spark, tmp_path) == both
    assert kept == {f: os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(f"{tmp_path}/index") for f in names if f.endswith("parquet")}


def test_a_batch_that_was_written_but_not_noted_is_replaced(spark, sf_dir, tmp_path):
    docs = documents(spark, sf_dir)
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    run_names(spark, tmp_path)
    want = index_of(spark, tmp_path)
    for f in os.listdir(f"{tmp_path}/checkpoint/commits"):  # as if the driver had died between write and commit
        os.remove(f"{tmp_path}/checkpoint/commits/{f}")
    assert run_names(spark, tmp_path) == 1
    assert index_of(spark, tmp_path) == want


def test_names_of_odd_rows_and_of_nothing(spark, tmp_path):
    rows = [(1, None, "a"), (2, "", "a"), (3, "# no\r\n  % no\n* no\nvdd VDD  vdd\r\n\x0bx\x0c y", "a"), (3, "vdd", "a"), (3, "vdd", "a"), (None, "vdd new", "a"), (4, "vdd", None), (5, "é £", ""), (9, "n " * 50_000, "b")]
    os.makedirs(f"{tmp_path}/in")
    assert run_names(spark, tmp_path) == 0 and index_of(spark, tmp_path) == []
    spark.createDataFrame([(i, t, g, 1, "z") for i, t, g in rows], "doc_id long, text string, source string, n int, name string").write.mode("append").parquet(f"{tmp_path}/in")
    run_names(spark, tmp_path)
    assert index_of(spark, tmp_path) == plain_index(rows)


def boxes(spark, at, rows, vias=()):
    spark.createDataFrame(list(rows), "id long, layer string, x0 double, y0 double, x1 double, y1 double, net string").write.mode("overwrite").parquet(f"{at}/shapes")
    spark.createDataFrame(list(vias), "id long, x double, y double, r double, layer string").write.mode("overwrite").parquet(f"{at}/vias")


def run_nets(spark, at, **own):
    layout_nets.run(spark, spark.read.parquet(f"{at}/shapes"), spark.read.parquet(f"{at}/vias"), f"{at}/out", NETS | own)
    return sorted(map(tuple, layout_nets.read(spark, f"{at}/out").collect()))


def test_nets_of_boxes_and_vias(spark, tmp_path):
    nan = float("nan")
    rows = [(1, "M 1", 0.0, 0.0, 10.0, 2.0, "x"), (2, "M 1", 9.0, 1.0, 20.0, 3.0, "x"), (3, "M 1", 0.0, 2.0, 5.0, 4.0, "x"), (4, "M/2", 0.0, 0.0, 4.0, 4.0, None), (5, "", 50.0, 0.0, 51.0, 1.0, None)]
    bad = [(None, "M 1", 0.0, 0.0, 1.0, 1.0, "x"), (6, None, 0.0, 0.0, 1.0, 1.0, "x"), (7, "M 1", nan, 0.0, 1.0, 1.0, "x"), (8, "M 1", 5.0, 0.0, 1.0, 1.0, "x"), (9, "M 1", 0.0, 0.0, 1.0, 1.0, "x"), (9, "M 1", 30.0, 0.0, 31.0, 1.0, "x"), (10, "M 1", None, 0.0, 1.0, 1.0, "x")]
    vias = [(1, 15.0, 2.0, 4.0, "v"), (2, 18.0, 2.0, 4.0, "v"), (3, 2.0, 3.9, 8.0, "v"), (4, 99.0, 99.0, 1.0, "v"), (5, None, 1.0, 1.0, "v"), (6, 50.0, 0.5, 0.0, "v"), (None, 1.0, 1.0, 1.0, "v")]
    boxes(spark, tmp_path, rows + bad, vias)
    want = [("", 5, 1, 50.0, 0.0, 51.0, 1.0, 1.0, 1, None), ("M 1", 1, 2, 0.0, 0.0, 20.0, 3.0, 42.0, 2, 2.0), ("M 1", 3, 1, 0.0, 2.0, 5.0, 4.0, 10.0, 1, 8.0), ("M/2", 4, 1, 0.0, 0.0, 4.0, 4.0, 16.0, 0, None)]
    assert run_nets(spark, tmp_path) == want and run_nets(spark, tmp_path) == want
    reasons = {r["reason"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out/rejected").groupBy("reason").count().collect()}
    assert reasons == {"no id or layer": 2, "coordinate is not a number": 2, "negative side": 1, "id is not unique": 2}


def test_nets_are_found_without_broadcasts(spark, tmp_path, monkeypatch):
    """A table that is broadcast passes through the driver whole; those of this job grow with the layout."""
    plans = []
    seen = lambda name, df: plans.append((name, "Broadcast" in df._jdf.queryExecution().executedPlan().toString()))
    for module in (layout_nets, closure):
        monkeypatch.setattr(module, "keep", lambda df, name, keep=module.keep: seen(name, df) or keep(df, name))
    monkeypatch.setattr(layout_nets, "nets", lambda *a, nets=layout_nets.nets: (out := nets(*a), seen("nets", out))[0])
    row = [(k, "a", 2.0 * k, 0.0, 2.0 * k + 2, 1.0, None) for k in range(40)]
    boxes(spark, tmp_path, [*row, (90, "b", 100.0, 0.0, 101.0, 1.0, None), (91, "b", 0.0, 0.0, 1.0, 1.0, None), (91, "b", 9.0, 0.0, 9.5, 1.0, None)], [(k, 2.0 * k, 0.5, 4.0, "v") for k in range(8)])
    assert run_nets(spark, tmp_path) == [("a", 0, 40, 0.0, 0.0, 80.0, 1.0, 80.0, 8, 0.5), ("b", 90, 1, 100.0, 0.0, 101.0, 1.0, 1.0, 0, None)]
    assert [name for name, _ in plans].count("edges") > 2 and {name for name, _ in plans} == {"tested", "vias", "edges", "named", "nets"}
    assert not [name for name, broadcast in plans if broadcast]


def test_only_the_asked_layers_are_replaced(spark, tmp_path):
    boxes(spark, tmp_path, [(1, "a", 0.0, 0.0, 1.0, 1.0, None), (2, "b", 0.0, 0.0, 1.0, 1.0, None)])
    run_nets(spark, tmp_path)
    boxes(spark, tmp_path, [(3, "a", 0.0, 0.0, 1.0, 1.0, None), (4, "b", 0.0, 0.0, 1.0, 1.0, None)])
    assert [(r[0], r[1]) for r in run_nets(spark, tmp_path, layers=["b"])] == [("a", 1), ("b", 4)]
    boxes(spark, tmp_path, [])
    assert run_nets(spark, tmp_path) == []


def test_unknown_settings_are_refused(tmp_path):
    (tmp_path / "own.yaml").write_text("bucket: 3\n")
    with pytest.raises(ValueError, match="bucket"):
        config(str(tmp_path / "own.yaml"), text_names.__file__)


def test_command_lines(spark, sf_dir, tmp_path):
    (tmp_path / "own.yaml").write_text("buckets: 2\nfiles_per_batch: 1\n")
    boxes(spark, tmp_path, [(1, "a", 0.0, 0.0, 1.0, 1.0, None)], [(1, 0.5, 0.5, 2.0, "v")])
    shutil.copytree(f"{ROOT}/jobs", f"{tmp_path}/elsewhere/jobs")
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    go = lambda *a: subprocess.run([sys.executable, "-m", *a], env=env, cwd=f"{tmp_path}/elsewhere", capture_output=True, text=True, timeout=300)
    documents(spark, sf_dir).limit(20).write.parquet(f"{tmp_path}/in")
    for said in ("1 new batches", "0 new batches"):
        out = go("jobs.text_names", f"{tmp_path}/in", f"{tmp_path}/index", f"{tmp_path}/checkpoint", "--config", f"{tmp_path}/own.yaml")
        assert out.returncode == 0 and said in out.stderr, out.stderr[-2000:]
    assert text_names.read(spark, f"{tmp_path}/index").agg(F.sum("n")).first()[0] > 20
    out = go("jobs.layout_nets", f"{tmp_path}/shapes", f"{tmp_path}/vias", f"{tmp_path}/out")
    assert out.returncode == 0 and "wrote 1 nets" in out.stderr, out.stderr[-2000:]
    assert [tuple(r)[:3] for r in layout_nets.read(spark, f"{tmp_path}/out").collect()] == [("a", 1, 1)]


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_queries_are_the_same_as_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "part", "orders"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    got, want = jobs.QUERIES[name](spark, sf_dir).toPandas(), con.sql(jobs.ORACLES[name]).df()
    tidy = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()), key=repr)
    assert tidy(got) == tidy(want) and len(got) > 10
    assert before == {k: spark.conf.get(k) for k in before}


def test_names_are_counted_with_one_shuffle_and_no_sort(spark):
    from jobs import text_names

    least, most = -(1 << 63), (1 << 63) - 1
    rows = [(most, "a a\n# a b\nb a", "s"), (least, "\n\nb\tc", "s"), (None, "d\r\nc d", "s"), (None, "e", None), (-7, "c\nz", "s"), (0, None, "s"), (1, "", "s")]
    out = text_names.index(spark.createDataFrame(rows, "id long, text string, `group` string"))
    got = {(r["group"], r["name"]): (r["n"], r["n_texts"], *r["first"]) for r in out.collect()}
    assert got == {("s", "a"): (3, 1, 0, most, 1), ("s", "b"): (2, 2, 0, least, 3), ("s", "c"): (3, 3, 0, least, 3), ("s", "d"): (2, 1, 1, None, 1), (None, "e"): (1, 1, 1, None, 1), ("s", "z"): (1, 1, 0, -7, 2)}
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
