"""Registered queries of the quality-analytics operators and the SQL that gives the same rows.

Every query reads whole tables. Doubles are rounded on both sides, to `digits` decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import arma, capability, competing, describe, design, forecasting, inference, interval_life, johnson, modality, models, msa, multivariate, nonparametric, pairs, regression, reliability, rows, spc, stressed_lives, survival_models, timeseries, trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, tables: str, sql: str | None = None, rounded: str = "", digits: int = 6):
    """Register a function of the named tables; `rounded` columns are rounded in the result and in the SQL."""
    columns = rounded.split()

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = function(*[table(spark, sf_dir, t) for t in tables.split()])
            return out.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})

        QUERIES[name] = run
        if sql is not None:
            swap = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in columns)
            SQL[name] = f"SELECT * REPLACE ({swap}) FROM ({sql})" if columns else sql
        return function

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["imr_chart"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Rows and cells ---------------------------------------------------------------------------------------------

_PROPS = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '*' WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 13 = 0 THEN 'abc' ELSE CAST(value AS VARCHAR) END AS cell FROM events"


def _cells(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    return e.withColumn("cell", F.when(i % 7 == 0, "*").when(i % 11 == 0, "n/a").when(i % 13 == 0, "abc").otherwise(F.col("value").cast("string")))


@query("column_kinds", "events", f"""
SELECT 'cell' AS "column", 'numeric' AS kind, count(*) FILTER (cell NOT IN ('*', 'n/a', 'abc')) AS n_valid, count(*) FILTER (cell IN ('*', 'n/a')) AS n_missing, count(*) FILTER (cell = 'abc') AS n_invalid FROM ({_PROPS})
UNION ALL SELECT 'event_type', CASE WHEN bool_and(regexp_matches(event_type, '[-/:Tt]')) THEN 'time' ELSE 'categorical' END, count(*), 0, 0 FROM events""")
def _(e):
    return rows.column_kinds(_cells(e), ["cell", "event_type"])


@query("extract_counts", "events", f"SELECT count(*) FILTER (event_id % 5 = 0) AS n_excluded, count(*) FILTER (event_id % 5 <> 0 AND cell IN ('*', 'n/a')) AS n_missing, count(*) FILTER (event_id % 5 <> 0 AND cell = 'abc') AS n_invalid, count(*) FILTER (event_id % 5 <> 0 AND cell NOT IN ('*', 'n/a', 'abc')) AS n_used FROM ({_PROPS})")
def _(e):
    return rows.extract_counts(_cells(e), "cell", F.col("event_id") % 5 == 0)


@query("extract_number", "events", f"SELECT event_id, CAST(cell AS DOUBLE) AS value FROM ({_PROPS}) WHERE cell NOT IN ('*', 'n/a', 'abc')", "value")
def _(e):
    return rows.extract_number(_cells(e).drop("value"), "cell").select("event_id", "value")


@query("row_visibility", "events", "SELECT count(*) AS n_rows, count(*) FILTER (event_id % 3 = 0) AS n_hidden, count(*) FILTER (event_id % 4 = 0) AS n_excluded, count(*) FILTER (event_id % 12 = 0) AS n_both, count(*) FILTER (event_id % 3 <> 0) AS n_shown, count(*) FILTER (event_id % 4 <> 0) AS n_analysed FROM events")
def _(e):
    return rows.visibility(e, F.col("event_id") % 3 == 0, F.col("event_id") % 4 == 0)


@query("structured_filter", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice >= 100000 AND o_orderstatus IS NOT NULL AND o_custkey <> 5")
def _(o):
    return rows.structured_filter(o, [("o_orderpriority", "LIKE", "1%"), ("o_totalprice", ">=", 100000), ("o_orderstatus", "IS NOT NULL"), ("o_custkey", "!=", 5)]).select("o_orderkey", "o_totalprice")


@query("worksheet_filter", "customer", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_mktsegment), 'build') AND (contains(CAST(c_custkey AS VARCHAR), '1') OR contains(lower(c_name), '1') OR contains(CAST(c_nationkey AS VARCHAR), '1') OR contains(CAST(c_acctbal AS VARCHAR), '1') OR contains(lower(c_mktsegment), '1'))")
def _(c):
    return rows.worksheet_filter(c, "1", {"c_mktsegment": "BUILD"}).select("c_custkey", "c_name")


@query("keyset_page", "lineitem", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey > 20 OR (l_orderkey = 20 AND l_linenumber > 2) ORDER BY 1, 2 LIMIT 100")
def _(li):
    return rows.keyset_page(li.select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey", "l_linenumber"], (20, 2), 100)


@query("rows_except", "orders customer", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)")
def _(o, c):
    return rows.without_rows(c, o.where("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey").select("c_custkey")


@query("stack_columns", "part", "SELECT p_partkey, factor, response FROM (UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) ON p_size, p_retailprice INTO NAME factor VALUE response)", "response")
def _(p):
    return rows.stack(p.select("p_partkey", F.col("p_size").cast("double"), "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


@query("mid_ranks", "part", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS mid_rank FROM part", "mid_rank")
def _(p):
    return rows.mid_ranks(p, "p_size").select("p_partkey", "mid_rank")


# Summaries and the data of plots ----------------------------------------------------------------------------

_DESCRIBE = """count({x}) AS n, count(*) FILTER ({x} IS NULL) AS n_missing, avg({x}) AS mean, stddev_samp({x}) / sqrt(count({x})) AS se_mean, stddev_samp({x}) AS stdev, stddev_pop({x}) AS stdev_pop,
var_samp({x}) AS variance, min({x}) AS minimum, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3, max({x}) AS maximum,
quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS iqr, max({x}) - min({x}) AS "range", sum({x}) AS "sum", skewness({x}) AS skewness, kurtosis({x}) AS kurtosis"""
_DESCRIBED = "mean se_mean stdev stdev_pop variance minimum q1 median q3 maximum iqr range sum skewness kurtosis"


@query("descriptive", "lineitem", f"SELECT {_DESCRIBE.format(x='l_quantity')} FROM lineitem", _DESCRIBED, 5)
def _(li):
    return describe.descriptive(li, "l_quantity")


@query("descriptive_by", "events", f"SELECT event_type, {_DESCRIBE.format(x='value')} FROM events GROUP BY event_type", _DESCRIBED, 4)
def _(e):
    return describe.descriptive(e, "value", ["event_type"])


@query("histogram", "events", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, greatest(5, least(30, ceil(log2(count(*)) + 1)))::INT AS k FROM events),
c AS (SELECT least(floor((value - lo) / ((hi - lo) / k)), k - 1)::INT AS bin, count(*) AS c FROM events, s GROUP BY 1)
SELECT b::INT AS bin, lo + b * ((hi - lo) / k) AS low, lo + (b + 1) * ((hi - lo) / k) AS high, coalesce(c, 0) AS count FROM (SELECT *, unnest(range(k)) AS b FROM s) LEFT JOIN c ON b = bin""", "low high")
def _(e):
    return describe.histogram(e, "value")


@query("histogram_edges", "part", """
SELECT b::INT AS bin, [900, 1000, 1200, 1500, 2000][b + 1]::DOUBLE AS low, [900, 1000, 1200, 1500, 2000][b + 2]::DOUBLE AS high, count(p_partkey) AS count
FROM (SELECT unnest(range(4)) AS b) LEFT JOIN part ON p_retailprice >= [900, 1000, 1200, 1500, 2000][b + 1] AND (p_retailprice < [900, 1000, 1200, 1500, 2000][b + 2] OR (b = 3 AND p_retailprice = 2000)) GROUP BY b""")
def _(p):
    return describe.histogram_edges(p, "p_retailprice", [900, 1000, 1200, 1500, 2000])


@query("box_plot", "orders", """
WITH q AS (SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
r AS (SELECT *, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM orders JOIN q USING (o_orderpriority))
SELECT o_orderpriority, n, q1, median, q3, min(o_totalprice) FILTER (inside) AS whisker_low, max(o_totalprice) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers FROM r GROUP BY ALL""", "q1 median q3 whisker_low whisker_high", 4)
def _(o):
    return describe.box_plot(o, "o_totalprice", ["o_orderpriority"])


@query("ecdf", "part", "SELECT DISTINCT p_retailprice AS x, cume_dist() OVER (ORDER BY p_retailprice) AS probability FROM part", "probability")
def _(p):
    return describe.ecdf(p, "p_retailprice")


@query("bar_counts", "events", "SELECT event_type AS category, sum(value) AS total, min(event_id) AS first_row FROM events GROUP BY 1", "total", 4)
def _(e):
    return describe.bar_counts(e, "event_type", "event_id", "value")


@query("pareto", "part", """
WITH c AS (SELECT p_type AS category, count(*) AS n FROM part WHERE trim(p_type) NOT IN ('', '*') GROUP BY 1),
s AS (SELECT *, sum(n) OVER () AS total, coalesce(sum(n) OVER (ORDER BY n DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
g AS (SELECT CASE WHEN 100 * before / total > 80 THEN 'Other' ELSE category END AS category, 100 * before / total > 80 AS other, sum(n) AS n, max(total) AS total FROM s GROUP BY 1, 2)
SELECT category, CAST(n AS BIGINT) AS count, 100 * n / total AS percent, 100 * sum(n) OVER (ORDER BY other, n DESC, category) / total AS cumulative_percent FROM g""", "percent cumulative_percent")
def _(p):
    return describe.pareto(p, "p_type", threshold=80.0)


@query("pie", "part", """
WITH c AS (SELECT p_brand AS category, sum(p_size)::DOUBLE AS w FROM part GROUP BY 1), s AS (SELECT *, 100 * w / sum(w) OVER () AS percent FROM c)
SELECT CASE WHEN percent < 4 THEN 'Other' ELSE category END AS category, sum(w) AS weight, sum(percent) AS percent FROM s GROUP BY 1""", "percent")
def _(p):
    return describe.pie(p, "p_brand", "p_size", 4.0)


@query("density", "part", """
WITH s AS (SELECT count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi, 0.9 * least(stddev_samp(p_retailprice), (quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25)) / 1.34) * count(*) ** -0.2 AS h FROM part),
g AS (SELECT *, lo - 3 * h + i * ((hi - lo + 6 * h) / 63) AS x FROM s, unnest(range(64)) AS t(i)),
v AS (SELECT p_retailprice AS v, count(*) AS c FROM part GROUP BY 1)
SELECT x, sum(c * exp(-0.5 * ((x - v) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density FROM g, v GROUP BY x""", "x density", 8)
def _(p):
    return describe.kde(p, "p_retailprice", bins=1 << 20)


@query("bins_2d", "orders lineitem", """
WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), s AS (SELECT min(x) AS x0, (max(x) - min(x)) / 10 AS xw, min(y) AS y0, (max(y) - min(y)) / 10 AS yw FROM r)
SELECT least(floor((x - x0) / xw), 9)::INT AS x_bin, least(floor((y - y0) / yw), 9)::INT AS y_bin, count(*) AS count FROM r, s GROUP BY 1, 2""")
def _(o, li):
    return describe.bins_2d(li, "l_quantity", "l_extendedprice", 10)


@query("interval_plot", "orders")
def _(o):
    return describe.interval(o, "o_totalprice", ["o_orderpriority"])


@query("category_heatmap", "lineitem", "SELECT l_returnflag, l_linestatus, avg(l_quantity) AS mean, count(*) AS count FROM lineitem GROUP BY 1, 2", "mean")
def _(li):
    return describe.category_heatmap(li, "l_returnflag", "l_linestatus", "l_quantity")


@query("variability", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_discount) AS mean, coalesce(stddev_samp(l_discount), 0) AS s FROM lineitem GROUP BY 1, 2", "mean s")
def _(li):
    return describe.variability(li, "l_discount", ["l_returnflag", "l_linestatus"])


@query("multi_vari", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))", "mean")
def _(li):
    return describe.multi_vari(li, "l_quantity", ["l_returnflag", "l_linestatus"])


@query("cause_and_effect", "nation region", "SELECT r_name, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS causes, count(DISTINCT n_name) AS n_causes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(n, r):
    return describe.cause_and_effect(n.join(r, n.n_regionkey == r.r_regionkey), "r_name", "n_name")


_CROSS = """WITH c AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS o FROM lineitem GROUP BY 1, 2), a AS (SELECT r, sum(o) AS rn FROM c GROUP BY 1), b AS (SELECT c, sum(o) AS cn FROM c GROUP BY 1), t AS (SELECT sum(o) AS n FROM c),
cells AS (SELECT r, c, coalesce(o, 0) AS o, rn * cn / n AS e, rn, cn, n FROM a CROSS JOIN b CROSS JOIN t LEFT JOIN c USING (r, c)) """


@query("cross_table", "lineitem", _CROSS + "SELECT r AS l_returnflag, c AS l_linestatus, CAST(o AS BIGINT) AS count, e AS expected, 100 * o / rn AS row_percent, 100 * o / cn AS column_percent, 100 * o / n AS total_percent, (o - e) / sqrt(e) AS residual, (o - e) / sqrt(e) / sqrt((1 - rn / n) * (1 - cn / n)) AS adjusted_residual FROM cells", "expected row_percent column_percent total_percent residual adjusted_residual")
def _(li):
    return describe.cross_table(li, "l_returnflag", "l_linestatus")


@query("chi_square", "lineitem", _CROSS + "SELECT sum((o - e) ** 2 / e) AS chi_square, 2 * sum(CASE WHEN o > 0 THEN o * ln(o / e) ELSE 0 END) AS likelihood_ratio, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS df, min(e) AS least_expected, CAST(sum(o) AS BIGINT) AS n FROM cells", "chi_square likelihood_ratio least_expected")
def _(li):
    return describe.chi_square(li, "l_returnflag", "l_linestatus").drop("p_value")


@query("chi_square_p", "orders")
def _(o):
    return describe.chi_square(o, "o_orderstatus", "o_orderpriority")


@query("chi_square_fit", "events", "WITH c AS (SELECT event_type AS category, count(*) AS observed FROM events GROUP BY 1), e AS (SELECT *, sum(observed) OVER () / count(*) OVER () AS expected FROM c) SELECT category, observed, expected, (observed - expected) ** 2 / expected AS contribution FROM e", "expected contribution")
def _(e):
    return describe.chi_square_fit(e, "event_type")


# Control charts ---------------------------------------------------------------------------------------------

_IMR = """WITH r AS (SELECT *, abs(value - lag(value) OVER w) AS moving_range FROM events WINDOW w AS (ORDER BY event_id)),
l AS (SELECT avg(value) AS centre, avg(moving_range) AS mr_centre, avg(moving_range) / 1.128 AS sigma FROM r) """


@query("imr_chart", "events", _IMR + """
, p AS (SELECT event_id, value, moving_range, centre, sigma, centre - 3 * sigma AS lower, centre + 3 * sigma AS upper, sign(value - centre) AS side, (value - centre) / sigma AS z, sign(value - lag(value) OVER (ORDER BY event_id)) AS step FROM r, l),
q AS (SELECT *, step * lag(step) OVER (ORDER BY event_id) AS turn FROM p),
e AS (SELECT *, sum((side = 1)::INT) OVER w9 = 9 OR sum((side = -1)::INT) OVER w9 = 9 AS e2, sum((step = 1)::INT) OVER w5 = 5 OR sum((step = -1)::INT) OVER w5 = 5 AS e3, sum((turn = -1)::INT) OVER w12 = 12 AS e4,
  count(*) OVER w3 = 3 AND (sum((z > 2)::INT) OVER w3 >= 2 OR sum((z < -2)::INT) OVER w3 >= 2) AS e5, count(*) OVER w5 = 5 AND (sum((z > 1)::INT) OVER w5 >= 4 OR sum((z < -1)::INT) OVER w5 >= 4) AS e6,
  sum((abs(z) < 1)::INT) OVER w15 = 15 AS e7, sum((abs(z) > 1)::INT) OVER w8 = 8 AS e8
  FROM q WINDOW w3 AS (ORDER BY event_id ROWS 2 PRECEDING), w5 AS (ORDER BY event_id ROWS 4 PRECEDING), w8 AS (ORDER BY event_id ROWS 7 PRECEDING), w9 AS (ORDER BY event_id ROWS 8 PRECEDING), w12 AS (ORDER BY event_id ROWS 11 PRECEDING), w15 AS (ORDER BY event_id ROWS 14 PRECEDING))
SELECT event_id, value, moving_range, centre, lower, upper, value < lower OR value > upper AS test_1,
  bool_or(coalesce(e2, false)) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS test_2, bool_or(coalesce(e3, false)) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS test_3,
  bool_or(coalesce(e4, false)) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING) AS test_4, bool_or(e5) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS test_5,
  bool_or(e6) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS test_6, bool_or(e7) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS test_7, bool_or(e8) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS test_8 FROM e""", "value moving_range centre lower upper", 5)
def _(e):
    return spc.individuals(e, "value", "event_id").select("event_id", "value", "moving_range", "centre", "lower", "upper", *[f"test_{t}" for t in spc.TESTS])


@query("imr_by_type", "events", f"""
WITH r AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id)) AS moving_range FROM events),
l AS (SELECT event_type, avg(value) AS centre, avg(moving_range) AS mr_centre FROM r GROUP BY 1)
SELECT event_type, event_id, value, moving_range, centre, mr_centre, centre - 3 * mr_centre / 1.128 AS lower, centre + 3 * mr_centre / 1.128 AS upper, {spc.range_factors(2)[2]!r} * mr_centre AS mr_upper FROM r JOIN l USING (event_type)""", "value moving_range centre mr_centre lower upper mr_upper", 2)
def _(e):
    return spc.individuals(e, "value", "event_id", ["event_type"]).select("event_type", "event_id", "value", "moving_range", "centre", "mr_centre", "lower", "upper", "mr_upper")


_SG = "WITH sg AS (SELECT event_id // 5 AS sg, count(*) AS n, avg(value) AS mean, max(value) - min(value) AS r, stddev_samp(value) AS s FROM events GROUP BY 1 HAVING count(*) = 5) "


def _grouped(e: DataFrame) -> DataFrame:
    return e.withColumn("sg", F.floor(F.col("event_id") / 5))


@query("xbar_r", "events", _SG + f", l AS (SELECT avg(mean) AS c, avg(r) AS rc FROM sg) SELECT sg, mean, r AS \"range\", c AS centre, c - {spc.range_factors(5)[0]!r} * rc AS lower, c + {spc.range_factors(5)[0]!r} * rc AS upper, rc AS r_centre, 0.0 * rc AS r_lower, {spc.range_factors(5)[2]!r} * rc AS r_upper, mean < c - {spc.range_factors(5)[0]!r} * rc OR mean > c + {spc.range_factors(5)[0]!r} * rc AS out FROM sg, l", "mean range centre lower upper r_centre r_lower r_upper", 5)
def _(e):
    return spc.xbar_r(_grouped(e), "value", "sg", 5)


@query("xbar_s", "events", _SG + f", l AS (SELECT avg(mean) AS c, avg(s) AS sc, {spc.c4(5)!r} AS k FROM sg) SELECT sg, mean, s, c AS centre, c - 3 / (k * sqrt(5)) * sc AS lower, c + 3 / (k * sqrt(5)) * sc AS upper, sc AS s_centre, 0.0 * sc AS s_lower, (1 + 3 * sqrt(1 - k * k) / k) * sc AS s_upper, abs(mean - c) > 3 / (k * sqrt(5)) * sc AS out FROM sg, l", "mean s centre lower upper s_centre s_lower s_upper", 5)
def _(e):
    return spc.xbar_s(_grouped(e), "value", "sg", 5)


@query("within_sigma", "events", _SG + "SELECT avg(r) / 2.326 AS sigma_within, count(*) AS n_subgroups FROM sg", "sigma_within")
def _(e):
    return spc.within_sigma(_grouped(e), "value", "sg", 5)


@query("imr_rs", "events", _SG + """, m AS (SELECT *, abs(mean - lag(mean) OVER (ORDER BY sg)) AS mr FROM sg), t AS (SELECT count(*) AS n_subgroups, avg(mean) AS centre, avg(mr) AS mr_centre, avg(r) / 2.326 AS sigma_within FROM m)
SELECT *, centre - 3 * mr_centre / 1.128 AS lower, centre + 3 * mr_centre / 1.128 AS upper, sqrt(greatest(0, (mr_centre / 1.128) ** 2 - sigma_within ** 2 / 5)) AS sigma_between, sqrt(greatest(0, (mr_centre / 1.128) ** 2 - sigma_within ** 2 / 5) + sigma_within ** 2) AS sigma_total FROM t""", "centre mr_centre lower upper sigma_within sigma_between sigma_total", 5)
def _(e):
    return spc.imr_rs(_grouped(e), "value", "sg", 5)


_MONTH = "WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) FILTER (l_returnflag = 'R') AS d, count(*) AS n FROM lineitem GROUP BY 1) "


def _monthly(li: DataFrame) -> DataFrame:
    return li.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count_if(F.col("l_returnflag") == "R").alias("d"), F.count("*").alias("n"))


for _kind, _value, _centre, _sd, _cap in (
    ("p", "d / n", "b", "sqrt(b * (1 - b) / n)", "least(1, {})"), ("np", "d", "n * b", "sqrt(n * b * (1 - b))", "{}"), ("u", "d / n", "b", "sqrt(b / n)", "{}"), ("c", "d", "b", "sqrt(b)", "{}"),
):
    @query(f"{_kind}_chart", "lineitem", _MONTH + f", t AS (SELECT {'sum(d) / count(*)' if _kind == 'c' else 'sum(d) / sum(n)'} AS b FROM m), p AS (SELECT month, d, n, CAST({_value} AS DOUBLE) AS value, {_centre} AS centre, {_sd} AS sd FROM m, t) SELECT month, d, n, value, centre, greatest(0, centre - 3 * sd) AS lower, {_cap.format('centre + 3 * sd')} AS upper, value < greatest(0, centre - 3 * sd) OR value > centre + 3 * sd AS out FROM p", "value centre lower upper")
    def _(li, kind=_kind):
        return spc.attribute_chart(_monthly(li), kind, "d", None if kind == "c" else "n")

for _kind in ("p", "u"):
    _sd = "sqrt(b * (1 - b) / n)" if _kind == "p" else "sqrt(b / n)"

    @query(f"laney_{_kind}_chart", "lineitem", _MONTH + f", t AS (SELECT sum(d) / sum(n) AS b FROM m), p AS (SELECT month, d, n, d / n AS value, b AS centre, {_sd} AS sd FROM m, t), z AS (SELECT avg(mr) / 1.128 AS sigma_z FROM (SELECT abs((value - centre) / sd - lag((value - centre) / sd) OVER (ORDER BY month)) AS mr FROM p)) SELECT month, d, n, value, centre, sigma_z, greatest(0, centre - 3 * sd * sigma_z) AS lower, {'least(1, centre + 3 * sd * sigma_z)' if _kind == 'p' else 'centre + 3 * sd * sigma_z'} AS upper, value < centre - 3 * sd * sigma_z OR value > centre + 3 * sd * sigma_z AS out FROM p, z", "value centre sigma_z lower upper")
    def _(li, kind=_kind):
        return spc.attribute_chart(_monthly(li), kind, "d", "n", laney=True, order="month")


@query("moving_average_chart", "events", """
WITH r AS (SELECT *, count(*) OVER w AS k, avg(value) OVER w AS ma, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id)) AS mr FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS 4 PRECEDING)), l AS (SELECT event_type, avg(value) AS centre, avg(mr) / 1.128 / sqrt(5) * 3 AS reach FROM r GROUP BY 1)
SELECT event_type, event_id, ma AS moving_average, centre, centre - reach AS lower, centre + reach AS upper, abs(ma - centre) > reach AS out FROM r JOIN l USING (event_type) WHERE k = 5""", "moving_average centre lower upper", 5)
def _(e):
    return spc.moving_average(e, "value", "event_id", ["event_type"]).select("event_type", "event_id", "moving_average", "centre", "lower", "upper", "out")


@query("ewma_chart", "events", """
WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER w AS i, avg(value) OVER (PARTITION BY user_id) AS m, stddev_samp(value) OVER (PARTITION BY user_id) AS sd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
z AS (SELECT user_id, event_id, i, m, sd, 0.2 * value + 0.8 * m AS ewma FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.event_id, s.i, s.m, s.sd, 0.2 * s.value + 0.8 * z.ewma FROM s JOIN z ON s.user_id = z.user_id AND s.i = z.i + 1)
SELECT user_id, event_id, ewma, m AS centre, m - 3 * sd * sqrt(0.2 / 1.8 * (1 - 0.8 ** (2 * i))) AS lower, m + 3 * sd * sqrt(0.2 / 1.8 * (1 - 0.8 ** (2 * i))) AS upper, abs(ewma - m) > 3 * sd * sqrt(0.2 / 1.8 * (1 - 0.8 ** (2 * i))) AS out FROM z""", "ewma centre lower upper", 5)
def _(e):
    return spc.ewma(e, "value", "event_id", ["user_id"])


@query("cusum_chart", "events", """
WITH s AS (SELECT event_type, event_id, sum(value - 70) OVER w AS u, sum(value - 30) OVER w AS l FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
SELECT event_type, event_id, u - least(0, min(u) OVER w) AS cusum_upper, l - greatest(0, max(l) OVER w) AS cusum_lower FROM s WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""", "cusum_upper cusum_lower", 3)
def _(e):
    return spc.cusum(e, "value", "event_id", ["event_type"], 50.0, 40.0).select("event_type", "event_id", "cusum_upper", "cusum_lower")


@query("zone_chart", "events", """
WITH r AS (SELECT *, abs(value - lag(value) OVER w) AS mr FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)), l AS (SELECT event_type, avg(value) AS c, avg(mr) / 1.128 AS s FROM r GROUP BY 1),
z AS (SELECT event_type, event_id, (value - c) / s AS z FROM r JOIN l USING (event_type)), y AS (SELECT *, CASE WHEN abs(z) < 1 THEN 0 WHEN abs(z) < 2 THEN 1 WHEN abs(z) < 3 THEN 2 ELSE 4 END AS weight, sign(z) AS side FROM z),
n AS (SELECT *, (weight = 0 OR side <> coalesce(lag(side) OVER (PARTITION BY event_type ORDER BY event_id), 0))::INT AS new FROM y), g AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM n)
SELECT event_type, event_id, weight, CAST(sum(weight) OVER (PARTITION BY event_type, run ORDER BY event_id) AS BIGINT) AS score FROM g""")
def _(e):
    return spc.zone(e, "value", "event_id", ["event_type"]).select("event_type", "event_id", "weight", "score")


@query("z_mr_chart", "events", """
WITH r AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id)) AS mr, avg(value) OVER (PARTITION BY event_type) AS c FROM events), l AS (SELECT avg(mr) / 1.128 AS s FROM r)
SELECT event_type, event_id, (value - c) / s AS z, mr / s AS z_range FROM r, l""", "z z_range")
def _(e):
    return spc.z_mr(e, "value", "event_id", "event_type").select("event_type", "event_id", "z", "z_range")


@query("g_chart", "part", """
WITH s AS (SELECT count(*) AS n, avg(p_size) AS mean, 1 - 1 / (avg(p_size) + 1) AS q FROM part), k AS (SELECT *, [floor(ln(1 - p) / ln(q)) + 1 FOR p IN [0.00135, 0.5, 0.99865]] AS ks FROM s),
v AS (SELECT n, mean, [greatest(0, ks[i] - 1 + ([0.00135, 0.5, 0.99865][i] - (1 - q ** (ks[i] - 1))) / ((1 - q ** ks[i]) - (1 - q ** (ks[i] - 1))) - 1) FOR i IN [1, 2, 3]] AS v FROM k) SELECT n, mean, v[1] AS lower, v[2] AS centre, v[3] AS upper FROM v""", "mean lower centre upper")
def _(p):
    return spc.g_chart(p, "p_size")


@query("runs_about_median", "events", """
WITH m AS (SELECT event_type, median(value) AS c FROM events GROUP BY 1), u AS (SELECT e.event_type, event_id, c, value > c AS up FROM events e JOIN m USING (event_type)), n AS (SELECT *, coalesce(up <> lag(up) OVER (PARTITION BY event_type ORDER BY event_id), true) AS new FROM u),
s AS (SELECT event_type, any_value(c) AS criterion, count(*) FILTER (new) AS runs, count(*) FILTER (up) AS above, count(*) FILTER (NOT up) AS below FROM n GROUP BY 1)
SELECT *, 1 + 2.0 * above * below / (above + below) AS expected, (runs - (1 + 2.0 * above * below / (above + below))) / sqrt(2.0 * above * below * (2.0 * above * below - (above + below)) / ((above + below) * (above + below) * (above + below - 1.0))) AS z FROM s""", "criterion expected z")
def _(e):
    return spc.runs(e, "value", "event_id", ["event_type"])


@query("hotelling_t2", "lineitem", """
WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS my, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount) AS b, var_samp(l_discount) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, (d * (l_quantity - mx) ** 2 - 2 * b * (l_quantity - mx) * (l_discount - my) + a * (l_discount - my) ** 2) / (a * d - b * b) AS t2 FROM lineitem, s""", "t2")
def _(li):
    return spc.hotelling(li, ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "t2")


@query("generalized_variance", "lineitem", "SELECT l_suppkey, var_samp(l_quantity) * var_samp(l_discount) - covar_samp(l_quantity, l_discount) ** 2 AS gv FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1", "gv")
def _(li):
    g = li.groupBy("l_suppkey").agg((F.var_samp("l_quantity") * F.var_samp("l_discount") - F.covar_samp("l_quantity", "l_discount") ** 2).alias("gv"))
    return g


@query("generalized_variance_chart", "events")
def _(e):
    return spc.generalized_variance(_grouped(e).withColumn("second", F.col("event_id") % 17 + F.col("value") / 3), "value", "second", "sg", 5)


@query("mewma_chart", "events")
def _(e):
    return spc.mewma(e.withColumn("second", (F.col("user_id") % 10).cast("double")), ["value", "second"], "event_id", ["event_type"])


# Inference --------------------------------------------------------------------------------------------------


@query("one_sample_t", "orders", "SELECT count(*) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS stdev, stddev_samp(o_totalprice) / sqrt(count(*)) AS se, (avg(o_totalprice) - 250000) / (stddev_samp(o_totalprice) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM orders", "mean stdev se t", 4)
def _(o):
    return inference.one_sample_t(o, "o_totalprice", 250000)


@query("one_sample_t_p", "orders")
def _(o):
    t = inference.one_sample_t(o, "o_totalprice", 250000).withColumn("difference", F.col("mean") - 250000)
    return inference.with_t_p(t, difference="difference")


@query("one_sample_z", "lineitem", "SELECT count(l_quantity) AS n, avg(l_quantity) AS mean, 14.0 / sqrt(count(l_quantity)) AS se, (avg(l_quantity) - 25) / (14.0 / sqrt(count(l_quantity))) AS z FROM lineitem", "mean se z")
def _(li):
    return inference.one_sample_z(li, "l_quantity", 25, 14.0)


_SIDES = """(SELECT count(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS n1, avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS mean1, var_samp(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS var1,
count(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS n2, avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS mean2, var_samp(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS var2 FROM customer)"""


@query("two_sample_t", "customer", f"SELECT *, mean1 - mean2 AS difference, sqrt(var1 / n1 + var2 / n2) AS se, (var1 / n1 + var2 / n2) ** 2 / ((var1 / n1) ** 2 / (n1 - 1) + (var2 / n2) ** 2 / (n2 - 1)) AS df, (mean1 - mean2) / sqrt(var1 / n1 + var2 / n2) AS t FROM {_SIDES}", "mean1 mean2 var1 var2 difference se df t", 3)
def _(c):
    return inference.two_sample_t(c, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")


@query("two_sample_t_pooled", "customer", f"SELECT difference, se, difference / se AS t, df FROM (SELECT mean1 - mean2 AS difference, n1 + n2 - 2.0 AS df, sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS se FROM {_SIDES})", "difference se t df", 4)
def _(c):
    return inference.two_sample_t(c, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY", pooled=True).select("difference", "se", "t", "df")


@query("paired_t", "lineitem", "SELECT count(*) AS n, avg(l_discount - l_tax) AS mean, stddev_samp(l_discount - l_tax) AS stdev, stddev_samp(l_discount - l_tax) / sqrt(count(*)) AS se, avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM lineitem", "mean stdev se t")
def _(li):
    return inference.paired_t(li, "l_discount", "l_tax")


_ANOVA = """WITH r AS (SELECT {g} AS g, CAST({x} AS DOUBLE) AS x FROM {t}), s AS (SELECT g, count(*) AS n, avg(x) AS m, coalesce(var_samp(x), 0) AS v FROM r GROUP BY 1), t AS (SELECT avg(x) AS grand FROM r),
a AS (SELECT sum(n * (m - grand) ** 2) AS ss_between, sum((n - 1) * v) AS ss_within, count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within FROM s, t)
SELECT *, (ss_between / df_between) / (ss_within / df_within) AS f, ss_between / (ss_between + ss_within) AS r_squared FROM a"""


@query("one_way_anova", "customer", _ANOVA.format(g="c_mktsegment", x="c_acctbal", t="customer"), "ss_between ss_within f r_squared", 2)
def _(c):
    return inference.one_way_anova(c, "c_acctbal", "c_mktsegment")


@query("one_way_anova_p", "customer")
def _(c):
    return inference.with_f_p(inference.one_way_anova(c, "c_acctbal", "c_mktsegment"))


_PAIRS = """WITH s AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), p AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS mse, CAST(sum(n) - count(*) AS BIGINT) AS df, count(*) * (count(*) - 1) / 2 AS pairs FROM s)
SELECT a.g AS first, b.g AS second, a.m - b.m AS difference, sqrt(mse * (1.0 / a.n + 1.0 / b.n)) AS se, (a.m - b.m) / sqrt(mse * (1.0 / a.n + 1.0 / b.n)) AS t, df, pairs FROM s a JOIN s b ON a.g < b.g, p"""


@query("pairwise_means", "customer", _PAIRS, "difference se t pairs", 4)
def _(c):
    return inference.pairwise_means(c, "c_acctbal", "c_mktsegment")


@query("pairwise_means_p", "customer")
def _(c):
    return inference.with_bonferroni(inference.pairwise_means(c, "c_acctbal", "c_mktsegment"))


@query("analysis_of_means", "orders")
def _(o):
    return inference.analysis_of_means(o, "o_totalprice", "o_orderpriority")


@query("two_factor_anova", "lineitem", """
WITH r AS (SELECT l_returnflag AS a, l_linestatus AS b, l_quantity AS y FROM lineitem),
ca AS (SELECT sum(d * d) AS ss FROM (SELECT y - avg(y) OVER () AS d FROM r)), ra AS (SELECT sum(d * d) AS ss FROM (SELECT y - avg(y) OVER (PARTITION BY a) AS d FROM r)), rf AS (SELECT sum(d * d) AS ss FROM (SELECT y - avg(y) OVER (PARTITION BY a, b) AS d FROM r)),
x AS (SELECT y - avg(y) OVER (PARTITION BY a) AS dy, (b = 'O')::INT - avg((b = 'O')::INT) OVER (PARTITION BY a) AS dx FROM r), rb AS (SELECT sum(dx * dy) ** 2 / sum(dx * dx) AS gain FROM x)
SELECT 'l_returnflag' AS term, ca.ss - ra.ss AS ss, 2 AS df FROM ca, ra UNION ALL SELECT 'l_linestatus', gain, 1 FROM rb UNION ALL SELECT 'l_returnflag*l_linestatus', ra.ss - gain - rf.ss, 2 FROM ra, rb, rf UNION ALL SELECT 'error', rf.ss, (SELECT count(*) - 6 FROM r) FROM rf""", "ss", 2)
def _(li):
    return inference.two_factor_anova(li, "l_quantity", "l_returnflag", "l_linestatus").select("term", "ss", "df")


_PROP = "(SELECT count(*) FILTER (l_returnflag = 'R') AS events, count(*) AS trials FROM lineitem)"


@query("one_proportion", "lineitem", f"SELECT events, trials, events / trials AS proportion, (events / trials - 0.33) / sqrt(0.33 * 0.67 / trials) AS z, ((events / trials + z2 / (2 * trials)) - sqrt(z2) * sqrt((events / trials) * (1 - events / trials) / trials + z2 / (4.0 * trials * trials))) / (1 + z2 / trials) AS wilson_low, ((events / trials + z2 / (2 * trials)) + sqrt(z2) * sqrt((events / trials) * (1 - events / trials) / trials + z2 / (4.0 * trials * trials))) / (1 + z2 / trials) AS wilson_high FROM {_PROP}, (SELECT 1.959963984540054 ** 2 AS z2)", "proportion z wilson_low wilson_high")
def _(li):
    return inference.one_proportion(li, F.col("l_returnflag") == "R", 0.33)


@query("one_proportion_exact", "lineitem")
def _(li):
    return inference.with_exact_proportion(inference.one_proportion(li, F.col("l_returnflag") == "R", 0.33), 0.33)


@query("two_proportions", "lineitem", """
WITH s AS (SELECT count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') AS events1, count(*) FILTER (l_linestatus = 'O') AS trials1, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'R') AS events2, count(*) FILTER (l_linestatus = 'F') AS trials2 FROM lineitem),
p AS (SELECT *, events1 / trials1 AS a, events2 / trials2 AS b FROM s) SELECT events1, trials1, events2, trials2, a - b AS difference, sqrt(a * (1 - a) / trials1 + b * (1 - b) / trials2) AS se, (a - b) / sqrt(a * (1 - a) / trials1 + b * (1 - b) / trials2) AS z FROM p""", "difference se z")
def _(li):
    return inference.two_proportions(li, F.col("l_returnflag") == "R", "l_linestatus", "O", "F")


@query("two_proportions_p", "lineitem")
def _(li):
    return inference.with_z_p(inference.two_proportions(li, F.col("l_returnflag") == "R", "l_linestatus", "O", "F"))


@query("one_poisson_rate", "part")
def _(p):
    return inference.one_poisson_rate(p, "p_size", 25.0)


@query("two_poisson_rates", "orders lineitem", """
WITH s AS (SELECT sum(l_quantity) FILTER (l_linestatus = 'O') AS events1, count(*) FILTER (l_linestatus = 'O') AS exposure1, sum(l_quantity) FILTER (l_linestatus = 'F') AS events2, count(*) FILTER (l_linestatus = 'F') AS exposure2 FROM lineitem)
SELECT *, events1 / exposure1 - events2 / exposure2 AS difference, (events1 / exposure1) / (events2 / exposure2) AS ratio, (events1 / exposure1 - events2 / exposure2) / sqrt(events1 / exposure1 / exposure1 + events2 / exposure2 / exposure2) AS z FROM s""", "difference ratio z")
def _(o, li):
    return inference.two_poisson_rates(li, "l_quantity", "l_linestatus", "O", "F")


@query("equivalence_paired", "lineitem", "WITH s AS (SELECT avg(l_discount - l_tax) AS difference, stddev_samp(l_discount - l_tax) / sqrt(count(*)) AS se FROM lineitem) SELECT difference, se, (difference + 0.02) / se AS t_lower, (difference - 0.02) / se AS t_upper FROM s", "difference se t_lower t_upper")
def _(li):
    t = inference.paired_t(li, "l_discount", "l_tax").withColumn("difference", F.col("mean"))
    return inference.equivalence(t, -0.02, 0.02).select("difference", "se", "t_lower", "t_upper")


@query("equivalence_two_sample", "customer", f"WITH s AS (SELECT mean1 - mean2 AS difference, sqrt(var1 / n1 + var2 / n2) AS se FROM {_SIDES}) SELECT difference, se, (difference + 500) / se AS t_lower, (difference - 500) / se AS t_upper FROM s", "difference se t_lower t_upper", 4)
def _(c):
    return inference.equivalence(inference.two_sample_t(c, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY"), -500, 500).select("difference", "se", "t_lower", "t_upper")


@query("equivalence_p", "customer")
def _(c):
    return inference.with_equivalence_p(inference.equivalence(inference.two_sample_t(c, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY"), -500, 500))


@query("one_variance", "lineitem", "SELECT count(*) AS n, var_samp(l_quantity) AS variance, (count(*) - 1) * var_samp(l_quantity) / 200 AS chi_square, count(*) - 1 AS df FROM lineitem", "variance chi_square", 4)
def _(li):
    return inference.one_variance(li, "l_quantity", 200.0)


@query("one_variance_p", "customer")
def _(c):
    return inference.with_variance_p(inference.one_variance(c, "c_acctbal", 1e7))


@query("two_variances", "customer", f"SELECT n1, n2, var1 / var2 AS f, n1 - 1 AS df1, n2 - 1 AS df2 FROM {_SIDES}", "f")
def _(c):
    return inference.two_variances(c, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY").select("n1", "n2", "f", "df1", "df2")


@query("brown_forsythe", "customer", _ANOVA.format(g="c_mktsegment", x="off", t="(SELECT c_mktsegment, abs(c_acctbal - m) AS off FROM customer JOIN (SELECT c_mktsegment, median(c_acctbal) AS m FROM customer GROUP BY 1) USING (c_mktsegment))"), "ss_between ss_within f r_squared", 2)
def _(c):
    return inference.levene(c, "c_acctbal", "c_mktsegment")


@query("bartlett", "customer", """
WITH g AS (SELECT count(*) - 1.0 AS d, var_samp(c_acctbal) AS v FROM customer GROUP BY c_mktsegment), s AS (SELECT count(*) AS k, sum(d) AS d, sum(d * v) AS ss, sum(d * ln(v)) AS lv, sum(1 / d) AS inv FROM g)
SELECT k, k - 1 AS df, (d * ln(ss / d) - lv) / (1 + (inv - 1 / d) / (3 * (k - 1))) AS chi_square FROM s""", "chi_square")
def _(c):
    return inference.bartlett(c, "c_acctbal", "c_mktsegment")


@query("correlations", "lineitem", " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, count(*) AS n, corr({a}, {b}) AS r, corr({a}, {b}) * sqrt((count(*) - 2) / (1 - corr({a}, {b}) ** 2)) AS t FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))), "r t", 5)
def _(li):
    return inference.correlations(li, ["l_quantity", "l_extendedprice", "l_discount"])


@query("grubbs", "part", "SELECT count(*) AS n, CASE WHEN max(p_retailprice) - avg(p_retailprice) >= avg(p_retailprice) - min(p_retailprice) THEN max(p_retailprice) ELSE min(p_retailprice) END AS outlier, greatest(max(p_retailprice) - avg(p_retailprice), avg(p_retailprice) - min(p_retailprice)) / stddev_samp(p_retailprice) AS g FROM part", "outlier g")
def _(p):
    return inference.grubbs(p, "p_retailprice")


@query("dixon", "supplier", "WITH s AS (SELECT list_sort(list(s_acctbal)) AS v FROM supplier) SELECT (v[2] - v[1]) / (v[-1] - v[1]) AS r_low, (v[-1] - v[-2]) / (v[-1] - v[1]) AS r_high FROM s", "r_low r_high")
def _(s):
    return inference.dixon(s, "s_acctbal")


@query("normal_plot", "events", "SELECT event_type, event_id, value AS x, (row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 0.375) / (count(*) OVER (PARTITION BY event_type) + 0.25) AS position FROM events", "x position")
def _(e):
    return inference.normal_plot(e, "value", "event_id", ["event_type"])


@query("anderson_darling", "events")
def _(e):
    return inference.anderson_darling(e, "value", ["event_type"])


@query("normal_tolerance", "part")
def _(p):
    return inference.normal_tolerance(p, "p_retailprice")


@query("bootstrap_mean", "part")
def _(p):
    return inference.bootstrap_mean(p, "p_retailprice", "p_partkey")


# Rank tests -------------------------------------------------------------------------------------------------

_RANKED = "SELECT *, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2 AS r FROM {t}"


@query("mann_whitney", "part", f"""
WITH p AS (SELECT * FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')), b AS (SELECT min(p_brand) AS lo, max(p_brand) AS hi FROM part), q AS (SELECT p_size, p_brand FROM part, b WHERE p_brand IN (lo, hi)), r AS ({_RANKED.format(x='p_size', t='q')}),
k AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM q GROUP BY p_size)),
s AS (SELECT count(*) FILTER (p_brand = lo) AS n1, count(*) FILTER (p_brand = hi) AS n2, sum(r.r) FILTER (p_brand = lo) AS w FROM r, b)
SELECT n1, n2, w, w - n1 * (n1 + 1) / 2 AS u, (w - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z, 1 - 2 * (w - n1 * (n1 + 1) / 2) / (n1 * n2) AS effect FROM s, k""", "w u z effect")
def _(p):
    ends = p.agg(F.min("p_brand"), F.max("p_brand")).first()
    return nonparametric.mann_whitney(p, "p_size", "p_brand", ends[0], ends[1])


@query("wilcoxon", "lineitem", f"""
WITH d AS (SELECT l_discount - l_tax AS d, abs(l_discount - l_tax) AS a FROM lineitem WHERE l_discount - l_tax <> 0), r AS ({_RANKED.format(x='a', t='d')}), k AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM d GROUP BY a)), s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r.r ELSE 0 END) AS w FROM r)
SELECT n, w, (w - n * (n + 1.0) / 4) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48) AS z FROM s, k""", "w z", 3)
def _(li):
    return nonparametric.wilcoxon(li, F.col("l_discount") - F.col("l_tax"))


@query("sign_test", "lineitem", "SELECT count(*) FILTER (l_quantity < 25) AS below, count(*) FILTER (l_quantity = 25) AS equal, count(*) FILTER (l_quantity > 25) AS above FROM lineitem")
def _(li):
    return nonparametric.sign_test(li, F.col("l_quantity"), 25)


@query("mood_median", "orders", """
WITH m AS (SELECT median(o_totalprice) AS median FROM orders), c AS (SELECT o_orderpriority, count(*) FILTER (o_totalprice <= median) AS l, count(*) FILTER (o_totalprice > median) AS h, count(*) AS n FROM orders, m GROUP BY 1), t AS (SELECT sum(l) AS tl, sum(h) AS th, sum(n) AS tn FROM c)
SELECT any_value(median) AS median, sum((l - n * tl / tn) ** 2 / (n * tl / tn) + (h - n * th / tn) ** 2 / (n * th / tn)) AS chi_square, count(*) - 1 AS df FROM c, t, m""", "median chi_square", 4)
def _(o):
    return nonparametric.mood_median(o, "o_totalprice", "o_orderpriority")


_KW = f"""WITH r AS ({_RANKED.format(x='p_size', t='part')}), k AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM part GROUP BY p_size)), g AS (SELECT p_brand, count(*) AS n, sum(r.r) AS rs, avg(r.r) AS mr FROM r GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS nn FROM g) """


@query("kruskal_wallis", "part", _KW + ", h AS (SELECT any_value(nn) AS nn, count(*) - 1 AS df, 12 / (any_value(nn) * (any_value(nn) + 1)) * sum(rs * rs / n) - 3 * (any_value(nn) + 1) AS h FROM g, t) SELECT CAST(nn AS BIGINT) AS n, df, h, h / (1 - ties / (nn ** 3 - nn)) AS h_adjusted FROM h, k", "h h_adjusted")
def _(p):
    return nonparametric.kruskal_wallis(p, "p_size", "p_brand")


@query("mean_ranks", "part", _KW + "SELECT p_brand, n, mr AS mean_rank, (mr - (nn + 1) / 2) / sqrt((nn + 1) * (nn / n - 1) / 12) AS z FROM g, t", "mean_rank z")
def _(p):
    return nonparametric.mean_ranks(p, "p_size", "p_brand")


@query("dunn", "part", _KW + "SELECT a.p_brand AS first, b.p_brand AS second, (a.mr - b.mr) / sqrt((nn * (nn + 1) / 12 - ties / (12 * (nn - 1))) * (1.0 / a.n + 1.0 / b.n)) AS z FROM g a JOIN g b ON a.p_brand < b.p_brand, t, k", "z")
def _(p):
    return nonparametric.dunn(p, "p_size", "p_brand")


@query("friedman", "lineitem", """
WITH x AS (SELECT row_number() OVER () AS id, l_discount * 100 AS a, l_tax * 100 AS b, l_quantity / 5 AS c FROM lineitem), u AS (SELECT id, t, v FROM x UNPIVOT (v FOR t IN (a, b, c))),
r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY v) + (count(*) OVER (PARTITION BY id, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY id, v)::DOUBLE AS m FROM u), s AS (SELECT t, sum(r) AS rs, sum(m * m - 1) AS ties FROM r GROUP BY 1), q AS (SELECT sum(rs * rs) AS q, sum(ties) AS ties, (SELECT count(*) FROM x)::DOUBLE AS n FROM s)
SELECT CAST(n AS BIGINT) AS blocks, 2 AS df, 12 / (n * 12) * q - 12 * n AS s, (12 / (n * 12) * q - 12 * n) / (1 - ties / (n * 24)) AS s_adjusted FROM q""", "s s_adjusted", 2)
def _(li):
    return nonparametric.friedman(li.select((F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b"), (F.col("l_quantity") / 5).alias("c")), "", ["a", "b", "c"])


@query("mcnemar", "labels", """WITH s AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS "both", count(*) FILTER (quality = 1 AND toxic <> 1) AS only_first, count(*) FILTER (quality <> 1 AND toxic = 1) AS only_second, count(*) FILTER (quality <> 1 AND toxic <> 1) AS neither FROM labels)
SELECT *, greatest(0, abs(only_first - only_second) - 1.0) ** 2 / (only_first + only_second) AS chi_square FROM s""", "chi_square")
def _(x):
    return nonparametric.mcnemar(x, F.col("quality") == 1, F.col("toxic") == 1)


@query("cochran_q", "lineitem", """
WITH x AS (SELECT (l_quantity > 25)::INT AS a, (l_discount > 0.05)::INT AS b, (l_tax > 0.04)::INT AS c FROM lineitem), s AS (SELECT count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(a + b + c) AS t, sum((a + b + c) ** 2) AS rr FROM x)
SELECT n, 2 AS df, 2 * (3 * (a * a + b * b + c * c) - t * t) / (3 * t - rr) AS q FROM s""", "q", 4)
def _(li):
    return nonparametric.cochran_q(li, [F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04])


@query("spearman", "part", "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part) SELECT count(*) AS n, corr(a, b) AS rho FROM r", "rho")
def _(p):
    return nonparametric.spearman(p, "p_size", "p_retailprice")


# Capability -------------------------------------------------------------------------------------------------


@query("normal_capability", "events", _SG + """, w AS (SELECT avg(r) / 2.326 AS sw FROM sg), s AS (SELECT count(*) AS n, avg(value) AS mean, sw AS sigma_within, stddev_samp(value) AS sigma_overall, 1e6 * count(*) FILTER (value < 5 OR value > 200) / count(*) AS observed_ppm FROM events, w GROUP BY sw)
SELECT *, 195 / (6 * sigma_within) AS cp, (mean - 5) / (3 * sigma_within) AS cpl, (200 - mean) / (3 * sigma_within) AS cpu, least((mean - 5), (200 - mean)) / (3 * sigma_within) AS cpk, 195 / (6 * sigma_overall) AS pp, (mean - 5) / (3 * sigma_overall) AS ppl, (200 - mean) / (3 * sigma_overall) AS ppu, least((mean - 5), (200 - mean)) / (3 * sigma_overall) AS ppk, 195 / (6 * sqrt(sigma_overall ** 2 + (mean - 50) ** 2)) AS cpm FROM s""", "mean sigma_within sigma_overall observed_ppm cp cpl cpu cpk pp ppl ppu ppk cpm", 5)
def _(e):
    return capability.normal_capability(_grouped(e), "value", "sg", 5, 5.0, 200.0, 50.0)


@query("capability_ppm", "events")
def _(e):
    c = capability.normal_capability(_grouped(e), "value", "sg", 5, 5.0, 200.0)
    return capability.with_index_intervals(capability.with_expected_ppm(c, 5.0, 200.0))


@query("between_within_capability", "events", _SG + """, m AS (SELECT *, abs(mean - lag(mean) OVER (ORDER BY sg)) AS mr FROM sg), t AS (SELECT count(*) AS n_subgroups, avg(mean) AS c, avg(mr) / 1.128 AS sm, avg(r) / 2.326 AS sigma_within FROM m), b AS (SELECT *, sqrt(greatest(0, sm ** 2 - sigma_within ** 2 / 5)) AS sigma_between FROM t), u AS (SELECT *, sqrt(sigma_between ** 2 + sigma_within ** 2) AS sigma_total FROM b)
SELECT n_subgroups, sigma_within, sigma_between, sigma_total, 195 / (6 * sigma_total) AS cp, least(c - 5, 200 - c) / (3 * sigma_total) AS cpk FROM u""", "sigma_within sigma_between sigma_total cp cpk", 5)
def _(e):
    return capability.between_within(_grouped(e), "value", "sg", 5, 5.0, 200.0)


@query("batch_capability", "part", "WITH s AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS s FROM part GROUP BY 1 HAVING count(*) >= 2 AND stddev_samp(p_retailprice) > 0) SELECT *, 1000 / (6 * s) AS cp, least(mean - 900, 1900 - mean) / (3 * s) AS cpk, 1000 / (6 * s) AS pp, least(mean - 900, 1900 - mean) / (3 * s) AS ppk FROM s", "mean s cp cpk pp ppk", 4)
def _(p):
    return capability.batch_capability(p, "p_retailprice", "p_brand", 900.0, 1900.0)


@query("nonparametric_capability", "part", """
WITH s AS (SELECT p_brand, count(*) AS n, list_sort(list(p_retailprice)) AS v FROM part GROUP BY 1 HAVING count(*) >= 10), q AS (SELECT p_brand, n, [v[floor(k)::INT] + (k - floor(k)) * (v[least(floor(k) + 1, n)::INT] - v[floor(k)::INT]) FOR k IN [least(greatest(p * (n + 1), 1), n) FOR p IN [0.00135, 0.5, 0.99865]]] AS q FROM s),
r AS (SELECT p_brand, n, q[1] AS low, q[2] AS median, q[3] AS high FROM q) SELECT *, 1000 / (high - low) AS cnp, (median - 900) / (median - low) AS cnpl, (1900 - median) / (high - median) AS cnpu, least((median - 900) / (median - low), (1900 - median) / (high - median)) AS cnpk FROM r""", "low median high cnp cnpl cnpu cnpk", 4)
def _(p):
    return capability.nonparametric(p, "p_retailprice", 900.0, 1900.0, ["p_brand"])


@query("box_cox", "part", """
WITH l AS (SELECT ln(p_retailprice) AS l FROM part WHERE p_retailprice > 0), g AS (SELECT avg(l) AS g FROM l), k AS (SELECT round(-5 + i * 0.01, 10)::DOUBLE AS power FROM range(1001) AS t(i))
SELECT power, stddev_samp(CASE WHEN power = 0 THEN exp(g) * (l - g) ELSE (exp(power * (l - g)) - 1) / power * exp(g) END) AS stdev FROM l, g, k GROUP BY 1""", "power stdev", 3)
def _(p):
    return capability.box_cox(p, "p_retailprice")


@query("binomial_capability", "lineitem")
def _(li):
    return capability.binomial_capability(_monthly(li), "d", "n")


@query("poisson_capability", "lineitem")
def _(li):
    return capability.poisson_capability(_monthly(li), "d", "n")


@query("stability_screen", "events", """
WITH r AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id)) AS mr FROM events), l AS (SELECT event_type, avg(value) AS c, avg(mr) / 1.128 AS s FROM r GROUP BY 1)
SELECT event_type, count(*) AS n, count(*) FILTER (abs(value - c) > 3 * s) AS n_out FROM events JOIN l USING (event_type) GROUP BY 1""")
def _(e):
    return capability.stability(e, "value", "event_id", ["event_type"])


# Measurement systems ----------------------------------------------------------------------------------------

def _gage(e: DataFrame) -> DataFrame:
    r = e.select("value", (F.col("event_id") % 30).alias("k"), F.floor(F.col("event_id") / 30).alias("rep"))
    full = r.groupBy("rep").agg(F.count("*").alias("n")).where("n = 30").select("rep")
    return r.join(full, "rep").select((F.col("k") % 10).alias("part"), F.floor(F.col("k") / 10).alias("operator"), "value")


_GAGE = "(SELECT k % 10 AS part, k // 10 AS operator, value FROM (SELECT value, event_id % 30 AS k, event_id // 30 AS rep, count(*) OVER (PARTITION BY event_id // 30) AS n FROM events) WHERE n = 30)"


@query("crossed_gage", "events", f"""
WITH d AS {_GAGE}, c AS (SELECT part, operator, count(*) AS r, avg(value) AS m, var_samp(value) AS v FROM d GROUP BY 1, 2), a AS (SELECT part, avg(m) AS m FROM c GROUP BY 1), b AS (SELECT operator, avg(m) AS m FROM c GROUP BY 1),
s AS (SELECT min(r)::DOUBLE AS r, var_pop(m) AS vm, avg(v) AS e, (SELECT var_pop(m) FROM a) AS va, (SELECT var_pop(m) FROM b) AS vb FROM c), q AS (SELECT r, e, 3 * r * 10 * va / 9 AS p, 10 * r * 3 * vb / 2 AS o, r * 30 * (vm - va - vb) / 18 AS po FROM s),
v AS (SELECT e AS rep, (o - po) / (10 * r) AS op, (po - e) / r AS it, (p - po) / (3 * r) AS pt FROM q), w AS (SELECT *, e0 + o0 + i0 AS g0, e0 + o0 + i0 + p0 AS t0 FROM (SELECT *, greatest(0, rep) AS e0, greatest(0, op) AS o0, greatest(0, it) AS i0, greatest(0, pt) AS p0 FROM v)),
u AS (SELECT unnest([struct_pack(s := 'repeatability', x := e0, y := rep), struct_pack(s := 'operator', x := o0, y := op), struct_pack(s := 'interaction', x := i0, y := it), struct_pack(s := 'part', x := p0, y := pt), struct_pack(s := 'reproducibility', x := o0 + i0, y := o0 + i0), struct_pack(s := 'gage', x := g0, y := g0), struct_pack(s := 'total', x := t0, y := t0)]) AS u, t0 FROM w)
SELECT u.s AS source, u.x AS variance, u.y AS raw_variance, sqrt(u.x) AS stdev, 6 * sqrt(u.x) AS study_variation, 100 * u.x / t0 AS percent_contribution, 100 * sqrt(u.x) / sqrt(t0) AS percent_study FROM u""", "variance raw_variance stdev study_variation percent_contribution percent_study", 4)
def _(e):
    return msa.crossed_gage(_gage(e), "value", "part", "operator").drop("ndc")


@query("emp_class", "events")
def _(e):
    return msa.emp_class(msa.crossed_gage(_gage(e), "value", "part", "operator"))


@query("nested_gage", "events", f"""
WITH d AS {_GAGE}, c AS (SELECT operator, part, count(*) AS r, avg(value) AS m, var_samp(value) AS v FROM d GROUP BY 1, 2), o AS (SELECT operator, count(*) AS p, min(r) AS r, avg(m) AS m, var_samp(m) AS vp, avg(v) AS e FROM c GROUP BY 1), s AS (SELECT min(p) AS p, min(r) AS r, var_samp(m) AS vo, avg(vp) AS vp, avg(e) AS e FROM o)
SELECT e AS repeatability, greatest(0, vo - vp / p) AS reproducibility, greatest(0, vp - e / r) AS part, e + greatest(0, vo - vp / p) + greatest(0, vp - e / r) AS total FROM s""", "repeatability reproducibility part total", 4)
def _(e):
    return msa.nested_gage(_gage(e), "value", "part", "operator")


@query("msa_type1", "lineitem", "WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS s, avg(l_quantity) - 25 AS bias FROM lineitem) SELECT n, mean, s, bias, bias / (s / sqrt(n)) AS t, 90 / (6 * s) AS cg, least(45 + bias, 45 - bias) / (3 * s) AS cgk, 600 * s / 90 AS percent_tolerance FROM s", "mean s bias t cg cgk percent_tolerance")
def _(li):
    return msa.type_1(li, "l_quantity", 25.0, 90.0)


@query("bias_linearity", "lineitem", "SELECT count(*) AS n, avg(l_discount - l_tax) AS mean_bias, regr_slope(l_discount - l_tax, l_tax) AS slope, regr_intercept(l_discount - l_tax, l_tax) AS intercept, regr_r2(l_discount - l_tax, l_tax) AS r_squared FROM lineitem", "mean_bias slope intercept r_squared")
def _(li):
    return msa.bias_linearity(li, "l_tax", "l_discount")


@query("attribute_agreement", "labels", """WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS c FROM labels GROUP BY 1, 2), t AS (SELECT sum(c) AS n, sum(c) FILTER (a = b) AS same FROM c), e AS (SELECT sum(x * y) AS xy FROM (SELECT a AS k, sum(c) AS x FROM c GROUP BY 1) JOIN (SELECT b AS k, sum(c) AS y FROM c GROUP BY 1) USING (k))
SELECT CAST(n AS BIGINT) AS n, same / n AS agreement, (same / n - xy / n ** 2) / (1 - xy / n ** 2) AS kappa FROM t, e""", "agreement kappa")
def _(x):
    return msa.agreement(x, F.col("quality"), F.col("toxic"))


@query("fleiss_kappa", "lineitem", """
WITH c AS (SELECT l_partkey, l_returnflag, count(*)::DOUBLE AS c FROM lineitem GROUP BY 1, 2), i AS (SELECT l_partkey, sum(c) AS m, sum(c * c) AS cc FROM c GROUP BY 1 HAVING sum(c) > 1), p AS (SELECT avg((cc - m) / (m * (m - 1))) AS p, count(*) AS items FROM i), s AS (SELECT l_returnflag, sum(c) AS c FROM c WHERE l_partkey IN (SELECT l_partkey FROM i) GROUP BY 1), e AS (SELECT sum(c * c) / sum(c) ** 2 AS pe FROM s)
SELECT items, p AS agreement, (p - pe) / (1 - pe) AS kappa FROM p, e""", "agreement kappa")
def _(li):
    return msa.fleiss_kappa(li, "l_partkey", "l_returnflag")


# Regression and multivariate --------------------------------------------------------------------------------


@query("simple_regression", "lineitem", "SELECT 'constant' AS term, regr_intercept(l_extendedprice, l_quantity) AS coefficient FROM lineitem UNION ALL SELECT 'l_quantity', regr_slope(l_extendedprice, l_quantity) FROM lineitem", "coefficient", 3)
def _(li):
    return regression.linear_regression(li, "l_extendedprice", ["l_quantity"]).select("term", "coefficient")


@query("linear_regression", "lineitem")
def _(li):
    return regression.linear_regression(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@query("regression_summary", "lineitem", """WITH s AS (SELECT count(*) AS n, regr_r2(l_extendedprice, l_quantity) AS r_squared, regr_syy(l_extendedprice, l_quantity) AS sst FROM lineitem)
SELECT n, sqrt(sst * (1 - r_squared) / (n - 2)) AS s, r_squared, 1 - (1 - r_squared) * (n - 1) / (n - 2) AS r_squared_adjusted, r_squared / ((1 - r_squared) / (n - 2)) AS f FROM s""", "s r_squared r_squared_adjusted f", 4)
def _(li):
    return regression.regression_summary(li, "l_extendedprice", ["l_quantity"]).select("n", "s", "r_squared", "r_squared_adjusted", "f")


@query("regression_diagnostics", "part", """
WITH s AS (SELECT count(*) AS n, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a, avg(p_size) AS m, regr_sxx(p_retailprice, p_size) AS sxx, regr_syy(p_retailprice, p_size) * (1 - regr_r2(p_retailprice, p_size)) / (count(*) - 2) AS mse FROM part),
r AS (SELECT p_partkey, a + b * p_size AS fitted, p_retailprice - a - b * p_size AS residual, 1.0 / n + (p_size - m) ** 2 / sxx AS leverage, mse, n FROM part, s), z AS (SELECT *, residual / sqrt(mse * (1 - leverage)) AS standardised FROM r)
SELECT p_partkey, fitted, residual, leverage, standardised, standardised * sqrt((n - 3) / (n - 2 - standardised ** 2)) AS deleted, standardised ** 2 * leverage / ((1 - leverage) * 2) AS cook, standardised * sqrt((n - 3) / (n - 2 - standardised ** 2)) * sqrt(leverage / (1 - leverage)) AS dfits FROM z""", "fitted residual leverage standardised deleted cook dfits", 5)
def _(p):
    return regression.regression_diagnostics(p, "p_retailprice", ["p_size"]).select("p_partkey", "fitted", "residual", "leverage", "standardised", "deleted", "cook", "dfits")


@query("durbin_watson", "events", """
WITH m AS (SELECT *, value - avg(value) OVER (PARTITION BY event_type) AS e FROM events), s AS (SELECT *, e - lag(e) OVER (PARTITION BY event_type ORDER BY event_id) AS d FROM m) SELECT event_type, sum(d * d) / sum(e * e) AS durbin_watson FROM s GROUP BY 1""", "durbin_watson")
def _(e):
    means = e.groupBy("event_type").agg(F.avg("value").alias("m"))
    return regression.durbin_watson(e.join(means, "event_type").withColumn("residual", F.col("value") - F.col("m")), "residual", "event_id", ["event_type"])


@query("best_subsets", "lineitem")
def _(li):
    return regression.best_subsets(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"])


@query("stepwise", "lineitem")
def _(li):
    return regression.stepwise(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"])


@query("fitted_line", "part")
def _(p):
    return regression.fitted_line(p, "p_retailprice", "p_size")


@query("logistic_regression", "labels documents")
def _(x, d):
    rows_ = x.join(d.select("doc_id", (F.col("n_chars") / 1000).alias("k_chars")), "doc_id")
    return regression.glm(rows_, F.col("quality"), ["k_chars"], "binomial")


@query("poisson_regression", "part")
def _(p):
    return regression.glm(p, F.col("p_size"), ["p_retailprice"], "poisson")


@query("pca", "lineitem")
def _(li):
    return multivariate.pca(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("pca_total_variance", "lineitem", "SELECT 4.0 AS total", "total")
def _(li):
    p = multivariate.pca(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return p.select("component", "eigenvalue").distinct().agg(F.sum("eigenvalue").alias("total"))


@query("kmeans_clusters", "part")
def _(p):
    return multivariate.kmeans(p, ["p_size", "p_retailprice"], "p_partkey", 4)[1]


@query("discriminant", "lineitem")
def _(li):
    return multivariate.confusion(multivariate.discriminant(li, ["l_quantity", "l_extendedprice"], "l_linestatus"), "l_linestatus")


# Time series ------------------------------------------------------------------------------------------------


@query("acf", "events", "WITH d AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS d, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), c AS (SELECT event_type, count(*) AS n, sum(d * d) AS c0 FROM d GROUP BY 1), p AS (SELECT a.event_type, b.i - a.i AS lag, sum(a.d * b.d) AS ck FROM d a JOIN d b ON a.event_type = b.event_type AND b.i BETWEEN a.i + 1 AND a.i + 20 GROUP BY 1, 2) SELECT event_type, n, CAST(lag AS INT) AS lag, ck / c0 AS acf, 1.959963984540054 / sqrt(n) AS band FROM p JOIN c USING (event_type)", "acf band")
def _(e):
    return timeseries.acf(e, "value", "event_id", ["event_type"])


@query("ljung_box", "events", "WITH d AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS d, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), c AS (SELECT event_type, count(*)::DOUBLE AS n, sum(d * d) AS c0 FROM d GROUP BY 1), p AS (SELECT a.event_type, b.i - a.i AS lag, sum(a.d * b.d) AS ck FROM d a JOIN d b ON a.event_type = b.event_type AND b.i BETWEEN a.i + 1 AND a.i + 20 GROUP BY 1, 2) SELECT event_type, CAST(lag AS INT) AS lag, n * (n + 2) * sum((ck / c0) ** 2 / (n - lag)) OVER (PARTITION BY event_type ORDER BY lag) AS ljung_box FROM p JOIN c USING (event_type)", "ljung_box", 5)
def _(e):
    return timeseries.ljung_box(timeseries.acf(e, "value", "event_id", ["event_type"]), ["event_type"]).select("event_type", "lag", "ljung_box")


@query("pacf", "events")
def _(e):
    return timeseries.pacf(timeseries.acf(e, "value", "event_id", ["event_type"]), ["event_type"])


@query("ccf", "events", "WITH d AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS x, user_id - avg(user_id) OVER (PARTITION BY event_type) AS y, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), c AS (SELECT event_type, sqrt(sum(x * x) * sum(y * y)) AS c FROM d GROUP BY 1) SELECT a.event_type, CAST(a.i - b.i AS INT) AS lag, sum(a.x * b.y) / any_value(c) AS ccf FROM d a JOIN d b ON a.event_type = b.event_type AND a.i BETWEEN b.i - 10 AND b.i + 10 JOIN c ON c.event_type = a.event_type GROUP BY 1, 2", "ccf")
def _(e):
    return timeseries.ccf(e, "value", "user_id", "event_id", ["event_type"])


_SES = """WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), z AS (SELECT user_id, event_id, i, value, value AS fitted, value AS level FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.event_id, s.i, s.value, z.level, 0.2 * s.value + 0.8 * z.level FROM s JOIN z ON s.user_id = z.user_id AND s.i = z.i + 1) """


@query("single_smoothing", "events", _SES + "SELECT user_id, event_id, fitted, value - fitted AS residual FROM z", "fitted residual")
def _(e):
    return timeseries.single_smoothing(e, "value", "event_id", ["user_id"])


@query("smoothing_accuracy", "events", _SES + "SELECT user_id, count(*) AS n, avg(abs(value - fitted)) AS mad, avg((value - fitted) ** 2) AS msd, 100 * sum(CASE WHEN value <> 0 THEN abs((value - fitted) / value) ELSE 0 END) / count(*) AS mape FROM z GROUP BY 1", "mad msd mape", 3)
def _(e):
    return timeseries.accuracy(timeseries.single_smoothing(e, "value", "event_id", ["user_id"]), ["user_id"])


@query("double_smoothing", "events")
def _(e):
    return timeseries.double_smoothing(e, "value", "event_id", ["event_type"])


@query("seasonal_smoothing", "events")
def _(e):
    return timeseries.seasonal_smoothing(e, "value", "event_id", ["event_type"], 12)


_CENTRED = "SELECT event_type, event_id, value, CASE WHEN count(*) OVER a = 4 AND count(*) OVER b = 4 THEN (avg(value) OVER a + avg(value) OVER b) / 2 END AS centred, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 4 AS phase FROM events WINDOW a AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), b AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)"


@query("centred_means", "events", f"SELECT event_type, event_id, centred FROM ({_CENTRED})", "centred")
def _(e):
    return timeseries.moving_average(e, "value", "event_id", ["event_type"], 4).select("event_type", "event_id", "centred")


@query("decomposition", "events", f"WITH r AS (SELECT event_type, phase, median(value - centred) AS raw FROM ({_CENTRED}) WHERE centred IS NOT NULL GROUP BY 1, 2) SELECT event_type, CAST(phase AS INT) AS phase, raw - (SELECT median(raw) FROM r AS q WHERE q.event_type = r.event_type) AS seasonal_index FROM r", "seasonal_index", 5)
def _(e):
    return timeseries.decompose(e, "value", "event_id", ["event_type"], 4)


@query("trend_line", "events", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS t FROM events) SELECT event_type, count(*) AS n, regr_intercept(value, t) AS intercept, regr_slope(value, t) AS slope, regr_r2(value, t) AS r_squared FROM r GROUP BY 1", "intercept slope r_squared")
def _(e):
    return timeseries.trend(e, "value", "event_id", ["event_type"])


@query("dickey_fuller", "events", "WITH r AS (SELECT event_type, value - lag(value) OVER w AS d, lag(value) OVER w AS l FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)), s AS (SELECT event_type, count(l) AS n, regr_slope(d, l) AS b, regr_sxx(d, l) AS sxx, regr_syy(d, l) * (1 - regr_r2(d, l)) AS sse FROM r WHERE l IS NOT NULL GROUP BY 1) SELECT event_type, n, b AS coefficient, b / sqrt(sse / (n - 2) / sxx) AS statistic, -2.86 AS critical_5 FROM s", "coefficient statistic critical_5", 5)
def _(e):
    return timeseries.dickey_fuller(e, "value", "event_id", ["event_type"])


@query("arima_candidates", "events")
def _(e):
    return timeseries.arima_candidates(e, "value", "event_id", ["event_type"])


# Reliability ------------------------------------------------------------------------------------------------

_RISK = "WITH c AS (SELECT l_quantity AS time, count(*) FILTER (l_linestatus = 'F') AS events, count(*) FILTER (l_linestatus <> 'F') AS censored FROM lineitem GROUP BY 1), r AS (SELECT *, CAST(sum(events + censored) OVER (ORDER BY time DESC) AS BIGINT) AS at_risk FROM c) "


@query("kaplan_meier", "lineitem", _RISK + """, s AS (SELECT *, CASE WHEN max((events = at_risk)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END AS survival, sum(CASE WHEN events < at_risk THEN events / (at_risk * (at_risk - events)) ELSE 0 END) OVER w AS g FROM r WINDOW w AS (ORDER BY time))
SELECT time, events, censored, at_risk, survival, survival * sqrt(g) AS se, CASE WHEN survival > 0 AND survival < 1 THEN survival ** exp(1.959963984540054 * sqrt(g) / abs(ln(survival))) END AS low, CASE WHEN survival > 0 AND survival < 1 THEN survival ** (1 / exp(1.959963984540054 * sqrt(g) / abs(ln(survival)))) END AS high FROM s""", "survival se low high")
def _(li):
    return reliability.kaplan_meier(li, "l_quantity", F.col("l_linestatus") == "F")


@query("log_rank", "lineitem", """
WITH t AS (SELECT l_quantity AS time, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS e1, count(*) FILTER (l_returnflag = 'R') AS a1, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS e0, count(*) FILTER (l_returnflag = 'A') AS a0 FROM lineitem GROUP BY 1),
n AS (SELECT *, sum(a1) OVER (ORDER BY time DESC) AS n1, sum(a0) OVER (ORDER BY time DESC) AS n0 FROM t), s AS (SELECT sum(e1) AS observed, sum((e1 + e0) * n1 / (n1 + n0)) AS expected, sum(CASE WHEN n1 + n0 > 1 THEN n1 * n0 * (e1 + e0) * (n1 + n0 - e1 - e0) / ((n1 + n0)::DOUBLE ** 2 * (n1 + n0 - 1)) ELSE 0 END) AS variance FROM n)
SELECT CAST(observed AS BIGINT) AS observed, expected, variance, (observed - expected) ** 2 / variance AS chi_square FROM s""", "expected variance chi_square", 5)
def _(li):
    return reliability.log_rank(li, "l_quantity", F.col("l_linestatus") == "F", "l_returnflag", "R", "A")


@query("exponential_life", "lineitem", "WITH s AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS events, sum(l_quantity) AS exposure, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1) SELECT *, events / exposure AS rate, exposure / events AS mean_life, events * ln(events / exposure) - events AS log_likelihood FROM s", "exposure rate mean_life log_likelihood", 4)
def _(li):
    return reliability.exponential(li, "l_quantity", F.col("l_linestatus") == "F", ["l_returnflag"])


@query("weibull_life", "lineitem")
def _(li):
    return reliability.weibull(li, "l_quantity", F.col("l_linestatus") == "F")


@query("cumulative_incidence", "lineitem", """
WITH r AS (SELECT l_quantity AS time, CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS mode FROM lineitem), c AS (SELECT time, mode, count(*) AS c FROM r GROUP BY 1, 2), t AS (SELECT time, sum(c) AS a, sum(c) FILTER (mode IS NOT NULL) AS d FROM c GROUP BY 1), n AS (SELECT time, coalesce(d, 0) AS d, sum(a) OVER (ORDER BY time DESC) AS n FROM t),
s AS (SELECT *, coalesce(exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE -800 END) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS s FROM n)
SELECT mode, time, c AS events, CAST(n AS BIGINT) AS at_risk, sum(s * c / n) OVER (PARTITION BY mode ORDER BY time) AS incidence FROM c JOIN s USING (time) WHERE mode IS NOT NULL""", "incidence")
def _(li):
    return reliability.cumulative_incidence(li, "l_quantity", F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")))


@query("warranty", "lineitem", "WITH s AS (SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS events, count(*) FILTER (l_linestatus = 'F') / sum(l_quantity) AS rate FROM lineitem GROUP BY 1) SELECT *, exp(-rate * 12) AS reliability, 1000 * (1 - exp(-rate * 12)) AS claims_per_1000 FROM s", "rate reliability claims_per_1000")
def _(li):
    return reliability.warranty(li, "l_quantity", F.col("l_linestatus") == "F", 12.0, ["l_returnflag"])


# Designs ----------------------------------------------------------------------------------------------------


def _factors(li: DataFrame) -> DataFrame:
    sign = lambda c: F.when(c, 1.0).otherwise(-1.0)
    return li.select(F.col("l_quantity").alias("y"), sign(F.col("l_linestatus") == "O").alias("a"), sign(F.col("l_discount") > 0.05).alias("b"), sign(F.col("l_tax") > 0.04).alias("c"))


_SIGNS = "WITH x AS (SELECT l_quantity AS y, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS a, CASE WHEN l_discount > 0.05 THEN 1 ELSE -1 END AS b, CASE WHEN l_tax > 0.04 THEN 1 ELSE -1 END AS c FROM lineitem) "


@query("factorial_effects", "lineitem", _SIGNS + " UNION ALL ".join(f"SELECT '{t}' AS term, avg(y) FILTER ({t} > 0) - avg(y) FILTER ({t} < 0) AS effect FROM x" for t in ("a", "b", "c", "a*b", "a*c", "b*c")), "effect")
def _(li):
    return design.effects(_factors(li), "y", ["a", "b", "c"])


@query("response_surface", "lineitem")
def _(li):
    rows_ = li.select("l_extendedprice", design.coded(F.col("l_quantity"), 1, 50).alias("q"), design.coded(F.col("l_discount"), 0, 0.1).alias("d"))
    return design.response_surface(rows_, "l_extendedprice", ["q", "d"])


@query("lack_of_fit", "lineitem")
def _(li):
    rows_ = li.select("l_extendedprice", design.coded(F.col("l_quantity"), 1, 50).alias("q"), design.coded(F.col("l_linenumber"), 1, 7).alias("n"))
    return design.lack_of_fit(rows_, "l_extendedprice", ["q", "n"])


@query("desirability", "part", "SELECT p_partkey, sqrt(greatest(0, least(1, (p_size - 1) / 49)) * greatest(0, least(1, CASE WHEN p_retailprice <= 1400 THEN (p_retailprice - 900) / 500 ELSE (2000 - p_retailprice) / 600 END))) AS desirability FROM part", "desirability")
def _(p):
    size, price = design.desirability(F.col("p_size"), "maximize", 1, 50), design.desirability(F.col("p_retailprice"), "target", 900, 2000, 1400)
    return p.select("p_partkey", F.sqrt(size * price).alias("desirability"))


@query("coded_units", "part", "SELECT p_partkey, (p_retailprice - 1450) / 550 AS coded, 1450 + (p_retailprice - 1450) / 550 * 550 AS actual FROM part", "coded actual")
def _(p):
    c = design.coded(F.col("p_retailprice"), 900, 2000)
    return p.select("p_partkey", c.alias("coded"), design.actual(c, 900, 2000).alias("actual"))


# Further summaries ------------------------------------------------------------------------------------------


@query("scatter_points", "part", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, p_brand AS level FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL", "x y")
def _(p):
    return rows.complete_rows(p, ["p_size", "p_retailprice"]).select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.col("p_brand").alias("level"))


@query("parallel_scaled", "part", "SELECT p_partkey, (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()) AS size_scaled, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS price_scaled FROM part", "size_scaled price_scaled")
def _(p):
    return describe.scaled(p, {"p_size": "size_scaled", "p_retailprice": "price_scaled"}).select("p_partkey", "size_scaled", "price_scaled")


@query("facet_levels", "events", "WITH f AS (SELECT event_type, min(event_id) AS first_row FROM events GROUP BY 1 ORDER BY 2 LIMIT 3) SELECT event_type, count(*) AS n, avg(value) AS mean FROM events WHERE event_type IN (SELECT event_type FROM f) GROUP BY 1", "mean")
def _(e):
    return describe.descriptive(describe.first_levels(e, "event_type", "event_id", 3), "value", ["event_type"]).select("event_type", "n", "mean")


@query("lag_points", "events", "SELECT event_type, event_id, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS before, value FROM events", "before value")
def _(e):
    return describe.lagged(e, "value", "event_id", ["event_type"]).select("event_type", "event_id", "before", "value")


@query("quantile_ranks", "customer", "SELECT c_custkey, percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS percent_rank, cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS cume_dist FROM customer", "percent_rank cume_dist")
def _(c):
    return nonparametric.quantile_ranks(c, "c_acctbal", ["c_mktsegment"]).select("c_custkey", "percent_rank", "cume_dist")


@query("poisson_fit", "orders", """
WITH d AS (SELECT o_custkey, count(*) AS x FROM orders GROUP BY 1), m AS (SELECT avg(x) AS mean, count(*) AS n FROM d), c AS (SELECT x, count(*) AS observed FROM d GROUP BY 1)
SELECT x, observed, n * exp(-mean + x * ln(mean) - lgamma(x + 1)) AS expected FROM c, m""", "expected", 5)
def _(o):
    return describe.poisson_fit(o.groupBy("o_custkey").agg(F.count("*").alias("x")), "x")


@query("contour_cells", "lineitem", "SELECT l_linenumber AS x, l_quantity AS y, avg(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2", "y z", 3)
def _(li):
    return describe.contour(li, "l_linenumber", "l_quantity", "l_extendedprice").select("x", "y", "z")


def _streamed_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of their file, against limits of the whole table, to the end of what is there."""
    from .plans.ordered import _scratch
    from .streaming.monitor import monitor

    still = table(spark, sf_dir, "events")
    limits = still.groupBy("event_type").agg(F.avg("value").alias("c"), F.stddev_samp("value").alias("s")).select("event_type", F.col("c").alias("centre"), (F.col("c") - 2 * F.col("s")).alias("lower"), (F.col("c") + 2 * F.col("s")).alias("upper"))
    stream = spark.readStream.schema(still.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    scratch, seen = _scratch(spark), []

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{scratch}/out")
        seen.append(True)

    out = monitor(stream, limits, "event_type", "value", "ts", "1 day").select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", F.round("mean", 6).alias("mean"), "n_out")
    out.writeStream.outputMode("complete").option("checkpointLocation", f"{scratch}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{scratch}/out") if seen else spark.createDataFrame([], out.schema)


QUERIES["streamed_monitor"] = _streamed_monitor
SQL["streamed_monitor"] = """WITH l AS (SELECT event_type, avg(value) - 2 * stddev_samp(value) AS lower, avg(value) + 2 * stddev_samp(value) AS upper FROM events GROUP BY 1)
SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (value < lower OR value > upper) AS n_out FROM events JOIN l USING (event_type) GROUP BY 1, 2"""


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV to the shared folder and read back, columns typed by their cells."""
    from .plans.ordered import _scratch
    from .sources.tables import read_csv

    path = _scratch(spark)
    table(spark, sf_dir, "orders").write.csv(path, header=True)
    text = read_csv(spark, path)
    return rows.column_kinds(text, ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"]).select("column", "kind", "n_valid")


QUERIES["csv_round_trip"] = _csv_round_trip
SQL["csv_round_trip"] = " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{k}' AS kind, count({c}) AS n_valid FROM orders""" for c, k in (("o_orderkey", "numeric"), ("o_totalprice", "numeric"), ("o_orderdate", "time"), ("o_orderpriority", "time")))


# Further tests and life models ------------------------------------------------------------------------------


@query("fisher_exact", "labels")
def _(x):
    return inference.fisher_exact(x, F.col("quality") == 1, F.col("toxic") == 1)


@query("equivalence_ratio", "customer", f"SELECT n1, n2, mean1 / mean2 AS ratio, (mean1 - 0.8 * mean2) / sqrt(var1 / n1 + 0.64 * var2 / n2) AS t_lower, (mean1 - 1.25 * mean2) / sqrt(var1 / n1 + 1.5625 * var2 / n2) AS t_upper FROM {_SIDES}", "ratio t_lower t_upper")
def _(c):
    return inference.equivalence_ratio(c, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY", 0.8, 1.25)


@query("equivalence_proportion", "lineitem", f"WITH s AS (SELECT events, trials, events / trials - 0.33 AS difference, sqrt(events / trials * (1 - events / trials) / trials) AS se FROM {_PROP}) SELECT *, (difference + 0.02) / se AS z_lower, (difference - 0.02) / se AS z_upper FROM s", "difference se z_lower z_upper")
def _(li):
    return inference.proportion_equivalence(li, F.col("l_returnflag") == "R", 0.33, -0.02, 0.02)


@query("nonparametric_tolerance", "orders")
def _(o):
    return inference.nonparametric_tolerance(o, "o_totalprice")


@query("bootstrap_two_sample", "customer")
def _(c):
    return inference.two_sample_bootstrap(c, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY", "c_custkey")


@query("nemenyi", "lineitem", """
WITH x AS (SELECT row_number() OVER () AS id, l_discount * 100 AS a, l_tax * 100 AS b, l_quantity / 5 AS c FROM lineitem), u AS (SELECT id, t, v FROM x UNPIVOT (v FOR t IN (a, b, c))), r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY v) + (count(*) OVER (PARTITION BY id, v) - 1) / 2 AS r FROM u), s AS (SELECT t, avg(r) AS m, count(*) AS n FROM r GROUP BY 1)
SELECT p.t AS first, q.t AS second, p.m - q.m AS difference, (p.m - q.m) / sqrt(12 / (6.0 * p.n)) AS z FROM s p JOIN s q ON p.t < q.t""", "difference z")
def _(li):
    return inference.nemenyi(li.select((F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b"), (F.col("l_quantity") / 5).alias("c")), ["a", "b", "c"])


@query("cox_regression", "lineitem")
def _(li):
    return survival_models.cox(li, "l_quantity", F.col("l_linestatus") == "F", ["l_discount", "l_tax"])


@query("log_rank_groups", "lineitem", """
WITH r AS (SELECT l_returnflag AS g, l_quantity AS time, count(*) FILTER (l_linestatus = 'F') AS e, count(*) AS a FROM lineitem GROUP BY 1, 2), t AS (SELECT time, sum(e) AS d, sum(a) AS a FROM r GROUP BY 1), n AS (SELECT time, d, sum(a) OVER (ORDER BY time DESC) AS n FROM t), gs AS (SELECT DISTINCT g FROM r),
x AS (SELECT n.time, gs.g, d, n, coalesce(e, 0) AS e, sum(coalesce(r.a, 0)) OVER (PARTITION BY gs.g ORDER BY n.time DESC) AS own FROM n CROSS JOIN gs LEFT JOIN r ON r.time = n.time AND r.g = gs.g) SELECT g AS l_returnflag, CAST(sum(e) AS BIGINT) AS observed, sum(d * own / n) AS expected FROM x GROUP BY 1""", "expected", 4)
def _(li):
    return survival_models.log_rank_groups(li, "l_quantity", F.col("l_linestatus") == "F", "l_returnflag")


@query("lognormal_life", "lineitem")
def _(li):
    return survival_models.lognormal(li, "l_quantity", F.col("l_linestatus") == "F")


@query("weibull_by_mode", "lineitem")
def _(li):
    return survival_models.weibull_by_mode(li, "l_quantity", F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")), ["A", "N", "R"])


@query("isolation_forest", "part")
def _(p):
    return models.isolation_forest(p, ["p_size", "p_retailprice"], "p_partkey").select("p_partkey", "score")


@query("classification_tree", "lineitem")
def _(li):
    return models.tree(li, "l_linestatus", ["l_quantity", "l_discount", "l_tax"])


@query("normal_mixture", "part")
def _(p):
    return models.mixture(p, "p_retailprice")


@query("nominal_logistic", "lineitem")
def _(li):
    return models.nominal_logistic(li, "l_returnflag", ["l_quantity", "l_discount"])


@query("ryan_joiner", "events")
def _(e):
    return models.ryan_joiner(e, "value", "event_id", ["event_type"])


@query("identify_distributions", "events")
def _(e):
    return models.identify_distributions(e, "value", "event_id", ["event_type"])


@query("t_chart", "events")
def _(e):
    return models.t_chart(e, "value")


@query("lognormal_capability", "part", "WITH s AS (SELECT p_brand, count(*) AS n, avg(ln(p_retailprice)) AS location, stddev_samp(ln(p_retailprice)) AS scale FROM part WHERE p_retailprice > 0 GROUP BY 1) SELECT *, (location - ln(900)) / scale / 3 AS ppl, (ln(1900) - location) / scale / 3 AS ppu, least((location - ln(900)) / scale / 3, (ln(1900) - location) / scale / 3) AS ppk FROM s", "location scale ppl ppu ppk")
def _(p):
    return models.lognormal_capability(p, "p_retailprice", 900.0, 1900.0, ["p_brand"])


@query("pairwise_rank_sums", "lineitem", " UNION ALL ".join(f"""SELECT '{a}' AS first, '{b}' AS second, sum(r) FILTER (l_returnflag = '{a}') AS w FROM (SELECT l_returnflag, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem WHERE l_returnflag IN ('{a}', '{b}'))""" for a, b in (("A", "N"), ("A", "R"), ("N", "R"))), "w", 1)
def _(li):
    return models.pairwise_rank_sums(li, "l_quantity", "l_returnflag", ["A", "N", "R"]).drop("z")


@query("median_interval", "orders")
def _(o):
    return models.median_interval(o, "o_totalprice")


@query("rolling_origin", "events")
def _(e):
    return models.rolling_origin(e, "value", "event_id", ["event_type"])


@query("expanded_gage", "events")
def _(e):
    r = e.select("value", (F.col("event_id") % 60).alias("k"), F.floor(F.col("event_id") / 60).alias("rep"))
    full = r.groupBy("rep").agg(F.count("*").alias("n")).where("n = 60").select("rep")
    cells = r.join(full, "rep").select((F.col("k") % 10).alias("part"), (F.floor(F.col("k") / 10) % 3).alias("operator"), F.floor(F.col("k") / 30).alias("day"), "value")
    return msa.expanded_gage(cells, "value", "part", "operator", "day")


@query("ordinal_logistic", "lineitem")
def _(li):
    return models.ordinal_logistic(li, "l_returnflag", ["A", "N", "R"], ["l_quantity", "l_discount"])


# Further forecasts, agreement, lives and checks ---------------------------------------------------------------


@query("arima_forecasts", "events")
def _(e):
    return forecasting.arima(e, "value", "event_id", ["event_type"])


@query("moving_average_model", "events")
def _(e):
    return forecasting.moving_average_model(e, "value", "event_id", ["event_type"])


@query("augmented_dickey_fuller", "events")
def _(e):
    return forecasting.augmented_dickey_fuller(e, "value", "event_id", ["event_type"])


@query("equivalence_two_proportions", "lineitem", "WITH c AS (SELECT count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS events1, count(*) FILTER (l_linestatus = 'F') AS trials1, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS events2, count(*) FILTER (l_linestatus = 'O') AS trials2 FROM lineitem), s AS (SELECT *, events1 / trials1 - events2 / trials2 AS difference, sqrt(events1 / trials1 * (1 - events1 / trials1) / trials1 + events2 / trials2 * (1 - events2 / trials2) / trials2) AS se FROM c) SELECT *, (difference + 0.02) / se AS z_lower, (difference - 0.02) / se AS z_upper FROM s", "difference se z_lower z_upper")
def _(li):
    return inference.two_proportion_equivalence(li, F.col("l_returnflag") == "R", "l_linestatus", "F", "O", -0.02, 0.02)


@query("equivalence_one_sample", "customer", "WITH s AS (SELECT count(c_acctbal) AS n, avg(c_acctbal) - 4500 AS difference, stddev_samp(c_acctbal) / sqrt(count(c_acctbal)) AS se FROM customer) SELECT *, (difference + 300) / se AS t_lower, (difference - 300) / se AS t_upper, n - 1 AS df FROM s", "difference se t_lower t_upper", 4)
def _(c):
    return inference.one_sample_equivalence(c, "c_acctbal", 4500, -300, 300)


@query("wilcoxon_one_sample", "lineitem", f"""
WITH d AS (SELECT l_quantity - 25 AS d, abs(l_quantity - 25) AS a FROM lineitem WHERE l_quantity <> 25), r AS ({_RANKED.format(x='a', t='d')}), k AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM d GROUP BY a)), s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r.r ELSE 0 END) AS w FROM r)
SELECT n, w, (w - n * (n + 1.0) / 4) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48) AS z FROM s, k""", "w z", 3)
def _(li):
    return nonparametric.wilcoxon(li, F.col("l_quantity") - 25)


@query("grouping_letters", "customer")
def _(c):
    pairs = inference.with_bonferroni(inference.pairwise_means(c, "c_acctbal", "c_mktsegment"))
    return inference.grouping_letters(pairs, c.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean")), "c_mktsegment")


@query("weighted_kappa", "lineitem", "WITH c AS (SELECT l_linenumber AS a, CAST(round(l_tax * 100) AS INT) AS b, count(*)::DOUBLE AS c FROM lineitem GROUP BY 1, 2), x AS (SELECT a, sum(c) AS x FROM c GROUP BY 1), y AS (SELECT b, sum(c) AS y FROM c GROUP BY 1), s AS (SELECT sum(c) AS n, sum(c * abs(a - b)) AS seen FROM c), e AS (SELECT sum(x * y * abs(a - b)) AS chance FROM x, y) SELECT CAST(n AS BIGINT) AS n, 1 - seen * n / chance AS kappa FROM s, e", "kappa")
def _(li):
    return msa.weighted_kappa(li, F.col("l_linenumber"), F.round(F.col("l_tax") * 100))


@query("kendall_w", "part", "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 + rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS t FROM part), k AS (SELECT sum(c) AS t FROM (SELECT count(*)::DOUBLE ** 3 - count(*) AS c FROM part GROUP BY p_size UNION ALL SELECT count(*)::DOUBLE ** 3 - count(*) FROM part GROUP BY p_retailprice)), s AS (SELECT count(*) AS items, count(*)::DOUBLE AS n, var_pop(r.t) * count(*) AS s FROM r), w AS (SELECT items, n, 12 * s / (4 * (n ** 3 - n) - 2 * k.t) AS w FROM s, k) SELECT items, 2 AS raters, w, 2 * (n - 1) * w AS chi_square FROM w", "w chi_square", 4)
def _(p):
    return msa.kendall_w(p, "p_partkey", ["p_size", "p_retailprice"])


@query("gage_stability", "events", """
WITH r AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id)) AS mr FROM events), l AS (SELECT event_type, avg(value) AS centre, avg(mr) / 1.128 AS sigma FROM r GROUP BY 1)
SELECT event_type, event_id, value, centre, centre - 3 * sigma AS lower, centre + 3 * sigma AS upper, abs(value - centre) > 3 * sigma AS test_1 FROM r JOIN l USING (event_type)""", "value centre lower upper", 2)
def _(e):
    return spc.individuals(e, "value", "event_id", ["event_type"]).select("event_type", "event_id", "value", "centre", "lower", "upper", "test_1")


@query("compare_lives", "lineitem")
def _(li):
    return reliability.compare_lives(li, "l_quantity", F.col("l_linestatus") == "F")


@query("interval_survival", "lineitem")
def _(li):
    return interval_life.turnbull(li.select((F.floor(F.col("l_quantity") / 5) * 5).alias("low"), F.when(F.col("l_linestatus") == "F", F.floor(F.col("l_quantity") / 5) * 5 + 5).alias("high")), "low", "high")


@query("bubble_points", "part", "SELECT p_partkey, p_size AS x, p_retailprice AS y, p_size % 7 - 1 AS size FROM part WHERE p_size % 7 >= 1")
def _(p):
    return describe.bubble_points(p.withColumn("s", F.col("p_size") % 7 - 1), "p_size", "p_retailprice", "s", "p_partkey")


@query("matrix_points", "part", "SELECT p_partkey, 'p_size' AS x_column, 'p_retailprice' AS y_column, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL")
def _(p):
    return describe.matrix_points(p, ["p_size", "p_retailprice"], "p_partkey")


@query("marginal_counts", "part", "WITH e AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part), r AS (SELECT 'x' AS axis, CAST(least(floor((p_size - a) / ((b - a) / 10)), 9) AS INT) AS bin FROM part, e UNION ALL SELECT 'y', CAST(least(floor((p_retailprice - c) / ((d - c) / 10)), 9) AS INT) FROM part, e) SELECT axis, bin, count(*) AS count FROM r GROUP BY 1, 2")
def _(p):
    return describe.marginal_counts(p, "p_size", "p_retailprice", 10)


@query("stacked_area", "orders", "WITH h AS (SELECT date_trunc('day', o_orderdate)::DATE AS day, o_orderpriority, sum(o_totalprice) AS height FROM orders GROUP BY 1, 2), t AS (SELECT *, sum(height) OVER (PARTITION BY day ORDER BY o_orderpriority ROWS UNBOUNDED PRECEDING) AS top FROM h) SELECT day, o_orderpriority, top - height AS bottom, top FROM t", "bottom top", 2)
def _(o):
    return describe.stacked_area(o.withColumn("day", F.to_date("o_orderdate")), "o_totalprice", "day", "o_orderpriority")


@query("key_faults", "lineitem", "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (l_orderkey IS NULL), 0) AS BIGINT) AS without_key, CAST(sum(n - 1) FILTER (l_orderkey IS NOT NULL) AS BIGINT) AS repeated FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def _(li):
    return rows.key_faults(li, "l_orderkey")


@query("worksheet_sort", "part", "SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS position FROM part")
def _(p):
    return rows.sorted_places(p, "p_size", "p_partkey", ascending=False).select("p_partkey", "p_size", "position")


@query("complete_rows", "events", f"SELECT event_id FROM ({_PROPS}) WHERE TRY_CAST(cell AS DOUBLE) IS NOT NULL")
def _(e):
    return rows.complete_rows(_cells(e).withColumn("number", rows.number(F.col("cell"))), ["number"]).select("event_id")


# Seasonal models, transforms, competing risks and pairs ------------------------------------------------------------


@query("seasonal_arima", "events")
def _(e):
    return arma.seasonal_arima(e, "value", "event_id", ["event_type"], [(1, 1, 0, 0), (1, 0, 0, 1), (0, 1, 1, 1)], 0, 1, 7, 7)


@query("johnson_fit", "events")
def _(e):
    return johnson.fit(e, "value", ["event_type"])


@query("johnson_capability", "supplier")
def _(s):
    return johnson.capability(s, "s_acctbal", -900.0, 9900.0)


@query("fine_gray", "lineitem")
def _(li):
    mode = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "A", "accepted")
    return competing.fine_gray(li, "l_quantity", mode, "returned", ["l_discount", "l_tax"])


@query("gray_test", "lineitem")
def _(li):
    mode = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "A", "accepted")
    return competing.gray_test(li, "l_quantity", mode, "returned", "l_linenumber")


@query("shift_interval", "customer", """
WITH v AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), n AS (SELECT count(*) FILTER (g = 'BUILDING') AS n1, count(*) FILTER (g = 'MACHINERY') AS n2 FROM v),
t AS (SELECT coalesce(sum(c * c * c - c), 0) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM v GROUP BY v)),
d AS (SELECT list(a.v - b.v ORDER BY a.v - b.v) AS d FROM v AS a, v AS b WHERE a.g = 'BUILDING' AND b.g = 'MACHINERY'),
k AS (SELECT n1, n2, greatest(0, floor(n1 * n2 / 2 - 1.959963984540054::DOUBLE * sqrt(n1::DOUBLE * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))))))::BIGINT AS low FROM n, t)
SELECT n1, n2, (d[(n1 * n2 + 1) // 2] + d[n1 * n2 // 2 + 1]) / 2 AS estimate, d[low + 1] AS low, d[n1 * n2 - low] AS high FROM d, k""", "estimate low high")
def _(c):
    return pairs.shift_interval(c, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")


@query("kendall_tau", "supplier", """
WITH s AS (SELECT s_suppkey AS i, s_acctbal AS x, s_nationkey AS y FROM supplier WHERE s_acctbal IS NOT NULL AND s_nationkey IS NOT NULL),
p AS (SELECT count(*) FILTER ((a.x < b.x) = (a.y < b.y) AND a.x <> b.x AND a.y <> b.y) AS concordant, count(*) FILTER ((a.x < b.x) <> (a.y < b.y) AND a.x <> b.x AND a.y <> b.y) AS discordant,
    count(*) FILTER (a.x = b.x) AS tx, count(*) FILTER (a.y = b.y) AS ty, count(*)::DOUBLE AS n0 FROM s AS a, s AS b WHERE a.i < b.i)
SELECT (SELECT count(*) FROM s) AS n, concordant, discordant, (concordant - discordant) / sqrt((n0 - tx) * (n0 - ty)) AS tau_b FROM p""", "tau_b")
def _(s):
    return pairs.kendall(s, F.col("s_acctbal"), F.col("s_nationkey")).drop("z", "p_value")


@query("dip_test", "events")
def _(e):
    return modality.dip_test(e, "value", ["event_type"], replicates=199)


@query("bimodality_screen", "events", """
WITH f AS (SELECT event_type, count(*) AS n, min(value) AS a, max(value) AS b, least(greatest(ceil(sqrt(count(*))), 8), 40)::INT AS bins FROM events WHERE isfinite(value) GROUP BY 1),
c AS (SELECT event_type, least(floor((value - a) / (b - a) * bins), bins - 1)::INT AS bin, count(*) AS c FROM events JOIN f USING (event_type) WHERE isfinite(value) AND n >= 30 AND b > a GROUP BY 1, 2),
g AS (SELECT event_type, bin, coalesce(c, 0) AS c FROM (SELECT event_type, unnest(range(bins))::INT AS bin FROM f WHERE n >= 30 AND b > a) LEFT JOIN c USING (event_type, bin)),
h AS (SELECT *, lag(c) OVER w AS l, lead(c) OVER w AS r FROM g WINDOW w AS (PARTITION BY event_type ORDER BY bin)),
p AS (SELECT * FROM h WHERE c > 0 AND ((l IS NULL AND c > r) OR (r IS NULL AND c > l) OR (c >= l AND c >= r AND (c > l OR c > r)))),
s AS (SELECT DISTINCT x.event_type FROM p AS x JOIN p AS y ON x.event_type = y.event_type AND y.bin >= x.bin + 2
    WHERE 5 * (SELECT min(c) FROM g WHERE g.event_type = x.event_type AND g.bin BETWEEN x.bin AND y.bin) <= 3 * least(x.c, y.c))
SELECT event_type, n, CASE WHEN n >= 30 AND b > a THEN bins END AS bins, CASE WHEN n < 30 THEN 0 WHEN b > a THEN (SELECT count(*) FROM p WHERE p.event_type = f.event_type) ELSE 1 END AS peaks,
    CASE WHEN n < 30 THEN 'insufficient_n' WHEN event_type IN (SELECT event_type FROM s) THEN 'suspected' ELSE 'clear' END AS status FROM f""")
def _(e):
    return modality.bimodality_screen(e, "value", ["event_type"])


@query("threshold_weibull", "lineitem")
def _(li):
    return stressed_lives.threshold_life(li, "l_quantity", F.col("l_linestatus") == "F")


@query("threshold_lognormal", "orders")
def _(o):
    return stressed_lives.threshold_life(o, "o_totalprice", F.col("o_orderstatus") != "O", "lognormal")


@query("threshold_exponential", "lineitem", """
WITH s AS (SELECT count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS failures, min(l_quantity)::DOUBLE AS threshold, sum(l_quantity)::DOUBLE AS total FROM lineitem WHERE l_quantity > 0 AND l_linestatus IS NOT NULL),
m AS (SELECT *, (total - n * threshold) / failures AS scale FROM s) SELECT threshold, scale, -failures * ln(scale) - failures AS log_likelihood, n, failures FROM m""", "threshold scale log_likelihood", 3)
def _(li):
    return stressed_lives.threshold_life(li, "l_quantity", F.col("l_linestatus") == "F", "exponential").select("threshold", "scale", "log_likelihood", "n", "failures")


@query("accelerated_life", "lineitem")
def _(li):
    terms, _ = stressed_lives.accelerated_life(li.withColumn("celsius", 40 + 5 * F.col("l_linenumber")), "l_quantity", F.col("l_linestatus") == "F", "celsius", [25.0])
    return terms


@query("lives_at_stress", "lineitem")
def _(li):
    _, lives = stressed_lives.accelerated_life(li.withColumn("celsius", 40 + 5 * F.col("l_linenumber")), "l_quantity", F.col("l_linestatus") == "F", "celsius", [25.0, 45.0, 75.0])
    return lives


@query("logistic_stepwise", "lineitem")
def _(li):
    return regression.logistic_stepwise(li, (1000 * F.col("l_quantity") + F.col("l_extendedprice") > 55000).cast("int"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"])


@query("logistic_scores", "lineitem", "SELECT l_orderkey, l_linenumber, 1 / (1 + exp(-(-1.2 + 0.01 * l_quantity - 2.0 * l_discount))) AS predicted FROM lineitem", "predicted", 9)
def _(li):
    return regression.glm_scores(li, {"constant": -1.2, "l_quantity": 0.01, "l_discount": -2.0}, "binomial").select("l_orderkey", "l_linenumber", "predicted")


@query("cart_tree", "lineitem")
def _(li):
    tree, _ = trees.fit_tree(li.withColumn("class", F.when(1000 * F.col("l_quantity") + F.col("l_extendedprice") > 55000, "large").otherwise("small")), "class", ["l_quantity", "l_discount", "l_tax"], max_depth=4, min_leaf=50)
    return tree


@query("cart_confusion", "part")
def _(p):
    _, rows = trees.fit_tree(p, "p_brand", ["p_size", "p_retailprice"], max_depth=3, min_leaf=20)
    return multivariate.confusion(rows, "p_brand")


@query("weibull_capability", "part")
def _(p):
    return models.weibull_capability(p, "p_retailprice", 900.0, 2000.0)


@query("dose_response", "lineitem")
def _(li):
    doses = li.groupBy("l_quantity").agg(F.count_if(F.col("l_extendedprice") > 40000).alias("events"), F.count("*").alias("trials"))
    return regression.dose_response(doses, "events", "trials", "l_quantity", "probit")
