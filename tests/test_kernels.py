"""Hand-computed and published values, and rules of the readers."""

import math
import random
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.functions import special
from sigmaloom.operators import capability, describe, design, inference, msa, nonparametric, regression, reliability, rows, spc, timeseries
from sigmaloom.plans import ordered
from sigmaloom.sources import tables


@pytest.mark.parametrize("value,known", [
    (special.t_cdf(2.0, 10), 0.963306), (special.t_quantile(0.975, 10), 2.228139), (special.chi2_right(18.307, 10), 0.05), (special.chi2_quantile(0.95, 1), 3.841459),
    (special.f_right(3.0984, 3, 20), 0.05), (special.beta_quantile(0.025, 3, 8), 0.066740), (special.poisson_cdf(3, 2.5), 0.757576), (special.binomial_cdf(3, 10, 0.3), 0.649611),
    (special.normal_cdf(1.96), 0.975002), (special.noncentral_t_cdf(2, 10, 1), 0.807612), (special.gamma_left(3, 10), 0.997231), (design.t_power(20, 0.5, 1.0), 0.564504),
    (design.t_power(30, 0.5, 1.0, samples=2), 0.477897), (spc.c4(5), 0.939986), (spc.range_factors(5)[0], 0.577), (spc.range_factors(2)[2], 3.2686),
])
def test_published_values(value, known):
    assert value == pytest.approx(known, abs=2e-4)


def test_individuals_by_hand(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "i int, x double")
    r = spc.individuals(df, "x", "i").orderBy("i").collect()
    assert [x.moving_range for x in r] == [None, 1.0, 1.0]
    assert (r[0].centre, r[0].mr_centre) == (2.0, 1.0)
    assert r[0].sigma == pytest.approx(0.8865248227) and r[0].upper == pytest.approx(4.6595744681) and r[0].mr_upper == pytest.approx(3.2686, abs=1e-3)


def _tests_by_scan(x, centre, sigma):
    """Special causes by checking every span of every length."""
    n, out = len(x), {t: [False] * len(x) for t in spc.TESTS}
    z, step = [(v - centre) / sigma for v in x], [None] + [np.sign(b - a) for a, b in zip(x, x[1:])]
    holds = {
        2: (9, lambda a: all(v > 0 for v in z[a : a + 9]) or all(v < 0 for v in z[a : a + 9])), 3: (6, lambda a: len(set(step[a + 1 : a + 6])) == 1 and step[a + 1] != 0),
        4: (14, lambda a: all(p * q == -1 for p, q in zip(step[a + 1 : a + 14], step[a + 2 : a + 14]))), 5: (3, lambda a: max(sum(v > 2 for v in z[a : a + 3]), sum(v < -2 for v in z[a : a + 3])) >= 2),
        6: (5, lambda a: max(sum(v > 1 for v in z[a : a + 5]), sum(v < -1 for v in z[a : a + 5])) >= 4), 7: (15, lambda a: all(abs(v) < 1 for v in z[a : a + 15])), 8: (8, lambda a: all(abs(v) > 1 for v in z[a : a + 8])),
    }
    out[1] = [abs(v) > 3 for v in z]
    for t, (k, f) in holds.items():
        for a in range(n - k + 1):
            if f(a):
                out[t][a : a + k] = [True] * k
    return out


def test_special_causes_and_blocks(spark, monkeypatch):
    rng = random.Random(4)
    x = [rng.gauss(0, 1) for _ in range(200)] + [5 + 0.1 * i for i in range(12)] + [(-1) ** i * 2.0 for i in range(30)] + [0.1 * rng.random() for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(x)), "i int, x double").repartition(5)
    whole = spc.blocked
    monkeypatch.setattr(spc, "blocked", lambda *a, **k: whole(*a, rows=37, **k))
    got = spc.individuals(df, "x", "i").orderBy("i").collect()
    assert [r.i for r in got] == list(range(len(x)))
    want = _tests_by_scan(x, got[0].centre, got[0].sigma)
    for t in spc.TESTS:
        assert [r[f"test_{t}"] for r in got] == want[t], t


def test_ranked_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("k")).repartition(6)
    assert [(r.k, r["rank"]) for r in ordered.ranked(df, "k").orderBy("k").collect()] == [(k, i) for i, k in enumerate(sorted(i * 7 % 1009 for i in range(1000)), 1)]


def test_cells(spark):
    cells = ["1", " 2.5e3 ", "0x1A", "-.5", "12d", "nan", "inf", "1e400", "*", "", "n/a", None, "abc"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = df.select(rows.number(F.col("c")).alias("v"), rows.cell_state(F.col("c")).alias("s")).collect()
    assert [r.v for r in got] == [1.0, 2500.0, 26.0, -0.5, None, None, None, None, None, None, None, None, None]
    assert [r.s for r in got] == ["valid"] * 4 + ["invalid", "missing", "invalid", "invalid", "missing", "missing", "missing", "missing", "invalid"]


def test_keyset_pages_cover_all_rows_once(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    seen, after = [], None
    while page := rows.keyset_page(df, ["a", "b"], after, 333).collect():
        seen += [(r.a, r.b) for r in page]
        after = seen[-1]
    assert seen == sorted((i % 7, i) for i in range(1000))


def test_pareto_keeps_the_category_that_crosses(spark):
    counts = {"a": 217, "b": 112, "c": 67, "d": 43, "e": 23, "f": 18, "*": 5}
    df = spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "c string")
    full = {r.category: r for r in describe.pareto(df, "c").collect()}
    assert full["a"].cumulative_percent == pytest.approx(45.2083, abs=1e-4) and full["f"].cumulative_percent == 100
    assert {r.category: r["count"] for r in describe.pareto(df, "c", threshold=80.0).collect()} == {"a": 217, "b": 112, "c": 67, "Other": 84}


def test_one_way_anova_by_hand(spark):
    df = spark.createDataFrame([(g, float(v)) for g, vs in (("A", (5, 6, 7)), ("B", (8, 9, 10)), ("C", (12, 13, 14))) for v in vs], "g string, y double")
    r = inference.one_way_anova(df, "y", "g").first()
    assert (r.ss_between, r.ss_within, r.df_between, r.df_within, r.f) == (pytest.approx(74), pytest.approx(6), 2, 6, pytest.approx(37))


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([(10.0, 1), (15.0, 0), (20.0, 1), (25.0, 0), (30.0, 1)], "t double, e int")
    got = {r.time: r.survival for r in reliability.kaplan_meier(df, "t", reliability.event_flag(F.col("e"))).collect()}
    assert got == {10.0: pytest.approx(0.8), 15.0: pytest.approx(0.8), 20.0: pytest.approx(0.533333, abs=1e-6), 25.0: pytest.approx(0.533333, abs=1e-6), 30.0: 0.0}


def test_regression_recovers_a_plane(spark):
    rng = random.Random(1)
    data = [(a, b, 3 + 2 * a - b + rng.gauss(0, 0.1)) for a, b in ((rng.random(), rng.random()) for _ in range(200))]
    df = spark.createDataFrame(data, "a double, b double, y double")
    x = np.array([[1, a, b] for a, b, _ in data])
    beta, *_ = np.linalg.lstsq(x, np.array([y for *_, y in data]), rcond=None)
    got = regression.linear_regression(df, "y", ["a", "b"]).collect()
    assert [r.coefficient for r in got] == pytest.approx(beta.tolist(), rel=1e-9)
    steps = regression.stepwise(df.withColumn("noise", F.lit(1.0) * (F.monotonically_increasing_id() % 3)), "y", ["a", "b", "noise"]).collect()
    assert {s.term for s in steps[:2]} == {"a", "b"}


def test_glm_solves_the_score_equations(spark):
    rng = random.Random(2)
    data = [(x, int(rng.random() < 1 / (1 + math.exp(-(0.5 + 1.5 * x))))) for x in (rng.gauss(0, 1) for _ in range(500))]
    df = spark.createDataFrame(data, "x double, y int")
    b = {r.term: r.coefficient for r in regression.glm(df, F.col("y"), ["x"], "binomial").collect()}
    p = [1 / (1 + math.exp(-(b["constant"] + b["x"] * x))) for x, _ in data]
    assert sum(y - q for (_, y), q in zip(data, p)) == pytest.approx(0, abs=1e-6)
    assert sum((y - q) * x for (x, y), q in zip(data, p)) == pytest.approx(0, abs=1e-6)


def test_weibull_solves_its_equation(spark):
    rng = random.Random(3)
    data = [(min(t, 1.5), int(t <= 1.5)) for t in (rng.weibullvariate(1.0, 2.0) for _ in range(800))]
    r = reliability.weibull(spark.createDataFrame(data, "t double, e int"), "t", F.col("e") == 1).first()
    assert r.shape == pytest.approx(2.0, abs=0.25) and r.scale == pytest.approx(1.0, abs=0.06)
    k, d = r.shape, sum(e for _, e in data)
    s = [t**k for t, _ in data]
    assert sum(v * math.log(t) for v, (t, _) in zip(s, data)) / sum(s) - 1 / k == pytest.approx(sum(math.log(t) for t, e in data if e) / d, abs=1e-8)


def test_gage_components_add_up(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(p, o, p + 0.3 * o + rng.gauss(0, 0.2)) for p in range(8) for o in range(3) for _ in range(2)], "p int, o int, y double")
    v = {r.source: r.variance for r in msa.crossed_gage(df, "y", "p", "o").collect()}
    assert v["total"] == pytest.approx(v["gage"] + v["part"]) and v["gage"] == pytest.approx(v["repeatability"] + v["reproducibility"]) and v["part"] > 1
    assert msa.crossed_gage(df.where("not (p = 0 and o = 0)"), "y", "p", "o").count() == 0


def test_designs(spark):
    d = design.factorial(spark, ["A", "B", "C"], {"D": "ABC"}, centres=2)
    assert d.count() == 10 and d.where("not centre and A * B * C <> D").count() == 0
    pb = np.array([r[1:] for r in design.plackett_burman(spark, list("ABCDEFGHIJK"), 12).collect()])
    assert (pb.T @ pb == 12 * np.eye(11)).all()
    assert design.central_composite(spark, ["A", "B"]).count() == 13 and design.box_behnken(spark, ["A", "B", "C"]).count() == 15
    assert sorted(r.run for r in design.randomised(d, 1, 2).collect()) == list(range(1, 11))
    assert design.sample_size(design.t_power, 0.8, difference=0.5, sigma=1.0) == 34


def test_rank_tests_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)], "g string, y double")
    r = nonparametric.mann_whitney(df, "y", "g", "a", "b").first()
    assert (r.w, r.u) == (7.0, 1.0)
    assert nonparametric.median_interval_ranks(20, 0.95)[0] == 6


def test_single_smoothing_by_hand(spark):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate((10, 12, 11))], "s int, i int, y double")
    assert [r.fitted for r in timeseries.single_smoothing(df, "y", "i", ["s"], 0.5).orderBy("i").collect()] == [10.0, 10.0, 11.0]


def test_capability_by_hand(spark):
    df = spark.createDataFrame([(i // 2, float(v)) for i, v in enumerate((9, 11, 10, 12, 8, 10))], "g int, y double")
    r = capability.normal_capability(df, "y", "g", 2, 4.0, 16.0).first()
    assert r.sigma_within == pytest.approx(2 / 1.128) and r.cp == pytest.approx(12 / (6 * 2 / 1.128)) and r.ppk == pytest.approx(2 / math.sqrt(2))


def test_csv_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿x;y;x\n1;"a;b";2\n\n3;"line\nbreak";\n', encoding="utf-8")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["x", "y", "x_2"] or len(set(df.columns)) == 3
    assert [tuple(r) for r in df.collect()] == [("1", "a;b", "2"), ("3", "line\nbreak", None)]


def test_xlsx_and_sqlite_sources(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>day</t></si><si><r><t>x</t></r><r><t>y</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="C2" s="1"><v>45000.5</v></c></row></sheetData></worksheet>')
    df = tables.read_table(spark, path)
    assert df.columns == ["name", "column_2", "day"] and tuple(df.first()) == ("xy", "", "2023-03-15 12:00:00")
    base = str(tmp_path / "a.db")
    with sqlite3.connect(base) as db:
        db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, None if i % 5 == 0 else f"v{i}") for i in range(1000)])
    tables.register(spark)
    read = spark.read.format("sqlite").option("table", "t").load(base)
    assert read.count() == 1000 and read.where("b is null").count() == 200
    with pytest.raises(ValueError):
        tables.read_table(spark, "old.xls")


def test_project_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    tables.save_project(df, str(tmp_path / "p"), [{"op": "drop", "row": 3}], {"page": df})
    back, log = tables.load_project(spark, str(tmp_path / "p"))
    assert tables.fingerprint(back) == tables.fingerprint(df) and log == [{"op": "drop", "row": 3}]


def test_expanded_gage_adds_up_and_refuses_unbalanced(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(p, o, d, p + 0.5 * o + 0.2 * d + rng.gauss(0, 0.3)) for p in range(6) for o in range(3) for d in range(2) for _ in range(2)], "p int, o int, d int, y double")
    v = {r.source: r for r in msa.expanded_gage(df, "y", "p", "o", "d").collect()}
    assert len(v) == 8 and sum(r.percent_contribution for r in v.values()) == pytest.approx(100)
    assert v["p"].variance > 1 and v["repeatability"].variance == pytest.approx(0.09, abs=0.05)
    assert msa.expanded_gage(df.where("not (p = 0 and d = 0)"), "y", "p", "o", "d").count() == 0


def test_ordinal_with_two_levels_is_logistic(spark):
    from sigmaloom.operators import models

    rng = random.Random(8)
    data = [(x, "b" if rng.random() < 1 / (1 + math.exp(-(0.4 + 1.2 * x))) else "a") for x in (rng.gauss(1, 2) for _ in range(400))]
    df = spark.createDataFrame(data, "x double, y string")
    o = {r.term: r for r in models.ordinal_logistic(df, "y", ["a", "b"], ["x"]).collect()}
    g = {r.term: r for r in regression.glm(df, F.col("y") == "b", ["x"], "binomial").collect()}
    assert o["x"].coefficient == pytest.approx(g["x"].coefficient, rel=1e-6) and o["cut a"].coefficient == pytest.approx(-g["constant"].coefficient, rel=1e-6)
    assert o["x"].se == pytest.approx(g["x"].se, rel=1e-5)
    m = {(r.level, r.term): r.coefficient for r in models.nominal_logistic(df, "y", ["x"]).collect()}
    assert m["a", "x"] == pytest.approx(-g["x"].coefficient, rel=1e-6)


def test_registry():
    from sigmaloom.plans import registry

    names = [n for n, _ in registry.recommend({"a": "numeric", "b": "categorical"}, "compare")]
    assert {"one_way_anova", "two_sample_t", "kruskal_wallis"} <= set(names[:4]) and "pca" not in names
    with pytest.raises(KeyError):
        registry.run("nothing", None)


@pytest.mark.parametrize("value,known", [(design.two_proportion_power(100, 0.5, 0.7), 0.83), (design.poisson_power(50, 2.0, 2.6), 0.8), (design.two_variance_power(30, 2.5), 0.67), (design.equivalence_power(40, 0.0, -0.5, 0.5, 1.0), 0.87), (design.factorial_power(4, 2, 1.0, 1.0), 0.46)])
def test_power_is_near(value, known):
    assert value == pytest.approx(known, abs=0.06)
