import io
import logging

from pyspark.sql import functions as F

from sheetspark import log
from sheetspark.operators import summary


def test_rho_summary_of_none_one_and_pairs(spark):
    df = spark.createDataFrame([(0, []), (1, [0.5]), (2, [0.3, 2.0, 0.7, 1.0]), (3, [0.3, 2.0, 9.0])], "id int, v array<double>")
    got = {r.id: r.s for r in df.select("id", summary.rho_summary(F.col("v")).alias("s")).collect()}
    assert got == {0: "-", 1: "0.5000 ohm/sq", 2: "0.7000..0.3000 ohm/sq @ 1.00..2.00um", 3: "0.3000..0.3000 ohm/sq @ 2.00..2.00um"}


def test_an_edge_within_a_group_counts_once_from_its_a_side(spark):
    drops = spark.createDataFrame([(0, 1, 2, 1.0, 0.5), (0, 3, 1, 2.0, 0.25), (0, 3, 4, 1.0, 9.0)], "key int, a long, b long, g double, du double")
    nodes = spark.createDataFrame([(0, 1), (0, 2)], "key int, node long")
    assert summary.group_current(drops, nodes).first()["i"] == 0.5 - 0.5


def test_links_nearest_to_vias(spark):
    vias = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "id long, x double, y double")
    links = spark.createDataFrame([(7, 1.0, 0.0), (8, 8.0, 9.0), (9, 40.0, 0.0)], "id long, x double, y double")
    assert {r.via: r.link for r in summary.nearest_links(vias, links, 2.0).collect()} == {1: 7, 2: 8}


def test_numbers_over_several_ranges(spark):
    got = summary.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7), "k").collect()
    assert sorted((r.k, r.number) for r in got) == [(k, k) for k in range(1000)]


def test_report_text(spark):
    power = spark.createDataFrame([("M1", 0.25, 25.0), ("M2", 0.75, 75.0)], "layer string, power double, share double")
    currents = spark.createDataFrame([("S", -0.1), ("D", 0.1)], "name string, i double")
    lines = summary.resistance_report(power, currents, 10.0).splitlines()
    assert lines[0] == "Resistance: 10 ohm" and lines[3].split() == ["M2", "7.500000e-01", "75.000"]
    assert [x.split()[0] for x in lines[-2:]] == ["D", "S"]


def test_messages_carry_level_and_section():
    log.configure("info")
    out = io.StringIO()
    log.LOG.handlers[0].setStream(out)
    with log.section("build"), log.section("vias"):
        log.LOG.warning("two left")
        log.LOG.debug("not shown")
    log.LOG.info("done")
    assert out.getvalue() == "[warning] [build/vias] two left\n[info] done\n"
    log.configure("off")
    assert not log.LOG.isEnabledFor(logging.CRITICAL)
