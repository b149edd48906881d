"""Profile and drift queries over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import counts as C
from tidemark.operators import drift as D
from tidemark.operators import profile as P
from tidemark.operators import slices as S
from tidemark.operators import windows as W
from tidemark.operators.running import group_id
from tidemark.operators.selection import order_statistics
from tidemark.queries.registry import dealt, query, spread, table
from tidemark.session import materialize
from tidemark.spec import (
    BASELINE,
    GenericTable,
    InferenceLog,
    MonitorSpec,
    TimeSeries,
)

LINEITEM_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
# All columns beside the timestamp, in one pass with sketches.
SKETCHED = MonitorSpec(
    TimeSeries("l_shipdate"), granularities=("1 month",), slicing_exprs=("l_returnflag", "l_quantity > 25")
)
EVERYTHING = SKETCHED.with_params(exact=True)
LINEITEM = EVERYTHING.with_params(columns=LINEITEM_COLUMNS)
YEARLY = LINEITEM.with_params(granularities=("1 year",))
SHIFT = 3.1e-8
AS_OF = dt.datetime(2024, 2, 1)


def lineitem(spark, sf) -> DataFrame:
    return dealt(table(spark, sf, "lineitem"), "l_orderkey")


def spread_lineitem(spark, sf) -> DataFrame:
    """The rows for queries that read them several times."""
    return spread(table(spark, sf, "lineitem"), "l_orderkey")


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison.

    The shift moves exact ties off the rounding edge, where the order of a sum would
    decide between two neighbours.  ``R`` is the same in SQL.
    """
    return F.round(c + F.lit(SHIFT), digits)


def R(sql: str, digits: int = 6) -> str:
    return f"round(({sql}) + {SHIFT}, {digits})"


def chi2_tail_sql(statistic: str, dof: str) -> str:
    """Upper tail of the chi-squared distribution: a series of 500 terms for the lower one."""
    a, h = f"(({dof}) / 2.0)", f"(({statistic}) / 2.0)"
    term = f"exp(({a} + k) * ln({h}) - {h} - lgamma({a} + k + 1))"
    return f"CASE WHEN {a} <= 0 THEN NULL WHEN {h} <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 500), lambda k: {term})) END"


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def flat(df: DataFrame, *metrics: str, digits: int = 6) -> DataFrame:
    """Windows as text, doubles rounded: comparable between engines."""
    types = dict(df.dtypes)
    out = []
    for name in metrics:
        if name in ("window", "window_cmp"):
            out.append(stamp(F.col(f"{name}.start")).alias(f"{name}_start"))
        elif types[name] == "double":
            out.append(rounded(F.col(name), digits).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


# SQL building blocks shared by the reference queries -------------------------

_MONTH_ROWS = """
rows_ AS (
  SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d %H:%M:%S') AS window_start, s.*, lineitem.*
  FROM lineitem, LATERAL (VALUES (NULL, NULL), ('l_returnflag', l_returnflag),
       ('l_quantity > 25', CAST(l_quantity > 25 AS VARCHAR))) AS s(slice_key, slice_value))
"""
_YEAR_ROWS = _MONTH_ROWS.replace("'month'", "'year'")


_NUMBERS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
}
_TEXTS = ("l_returnflag", "l_linestatus")
_KEYS = "window_start, slice_key, slice_value"


def _profile_sql(exact: bool) -> str:
    """All metrics of all columns; with ``exact`` those that take value counts too."""

    def counted(c: str, number: bool) -> str:
        if not exact:
            return ""
        median = R(f"quantile_disc({c}, 0.5)", 4) if number else "NULL"
        return f"""count(DISTINCT {c}) AS distinct_count, {R(f'count(DISTINCT {c}) / nullif(count({c}), 0)')} AS percent_distinct,
            {median} AS median,"""

    base = 'count(*) AS "count", count(*) - count({c}) AS num_nulls,'
    parts = [
        f"""SELECT {_KEYS}, '{c}' AS column_name, '{t}' AS data_type, {base.format(c=c)} {counted(c, True)}
        {R(f'min({c})', 4)} AS "min", {R(f'max({c})', 4)} AS "max", {R(f'avg({c})', 4)} AS "avg", {R(f'stddev_samp({c})', 4)} AS stddev,
        {R(f'count(*) FILTER ({c} = 0) / nullif(count({c}), 0)')} AS percent_zeros, NULL::DOUBLE AS avg_length,
        NULL::BIGINT AS non_null_columns FROM rows_ GROUP BY ALL"""
        for c, t in _NUMBERS.items()
    ]
    parts += [
        f"""SELECT {_KEYS}, '{c}', 'string', {base.format(c=c)} {counted(c, False)} NULL, NULL, NULL, NULL, NULL,
        {R(f'avg(length({c}))')}, NULL FROM rows_ GROUP BY ALL"""
        for c in _TEXTS
    ]
    filled = " + ".join(f"(count({c}) > 0)::INT" for c in (*_NUMBERS, *_TEXTS))
    parts.append(
        f"""SELECT {_KEYS}, ':table', NULL, count(*), NULL, {'NULL, NULL, NULL,' if exact else ''}
        NULL, NULL, NULL, NULL, NULL, NULL, {filled} FROM rows_ GROUP BY ALL"""
    )
    return f"WITH {_MONTH_ROWS} " + " UNION ALL ".join(parts)


def _profile_out(rows: DataFrame, exact: bool) -> DataFrame:
    names = ["window", "slice_key", "slice_value", "column_name", "data_type", "count", "num_nulls"]
    coarse = {m: rounded(F.col(m), 4).alias(m) for m in ("min", "max", "avg", "stddev", "median")}
    fine = {m: rounded(F.col(m)).alias(m) for m in ("percent_zeros", "avg_length", "percent_distinct")}
    wanted = ["min", "max", "avg", "stddev", "percent_zeros", "avg_length", "non_null_columns"]
    wanted += ["distinct_count", "percent_distinct", "median"] if exact else []
    flat_ = [stamp(F.col("window.start")).alias("window_start"), *[F.col(n) for n in names[1:]]]
    return rows.select(*flat_, *[(coarse | fine).get(m, F.col(m)) for m in wanted])


@query("d14_long_profile", _profile_sql(exact=False))
def long_profile(spark, sf):
    """Every column of every month and slice in one scan; estimates are left to the next two."""
    return _profile_out(P.profile(lineitem(spark, sf), SKETCHED), exact=False)


@query("d14_exact_profile", _profile_sql(exact=True))
def exact_profile(spark, sf):
    return _profile_out(P.profile(spread_lineitem(spark, sf), EVERYTHING), exact=True)


@query(
    "d14_sketch_errors",
    f"""WITH {_MONTH_ROWS} """
    + " UNION ALL ".join(
        f"SELECT {_KEYS}, '{c}' AS column_name, true AS distinct_close, true AS median_close FROM rows_ GROUP BY ALL"
        for c in _NUMBERS
    ),
)
def sketch_errors(spark, sf):
    """Distinct counts within a tenth of the exact ones, medians within a hundredth of the ranks."""
    df, names = spread_lineitem(spark, sf), list(_NUMBERS)
    rows = materialize(P.profile(df, SKETCHED).where("data_type != 'string'").withColumn("_gid", group_id(P.GROUP)), "profile")
    cells = P.cell_rows(df, SKETCHED.with_params(columns=tuple(names)))
    exact = materialize(P.distinct_of_cells(cells, names).withColumnRenamed("distinct_count", "exact"), "distinct")
    # The estimates of a group side by side; its rows count themselves below and up to them.
    sides = rows.groupBy("_gid").agg(*[F.max(F.when(F.col("column_name") == c, F.col("median"))).alias(f"_m{i}") for i, c in enumerate(names)])
    placed = cells.select(F.explode("_gids").alias("_gid"), *names).join(materialize(sides, "sides"), "_gid")
    counted = [
        F.struct(
            F.lit(c).alias("column_name"), F.count(c).alias("n"),
            F.count_if(F.col(c).cast("double") < F.col(f"_m{i}")).alias("below"), F.count_if(F.col(c).cast("double") <= F.col(f"_m{i}")).alias("upto"),
        ).alias(f"_c{i}")
        for i, c in enumerate(names)
    ]
    wide = placed.groupBy("_gid").agg(*counted)
    ranks = wide.select("_gid", F.explode(F.array(*[f"_c{i}" for i in range(len(names))])).alias("_c")).select("_gid", "_c.*")
    by = ["_gid", "column_name"]
    n, values = F.nullif("n", F.lit(0)), F.coalesce("exact", F.lit(0))
    out = rows.join(materialize(ranks, "ranks"), by).join(exact, by, "left").withColumns({
        "distinct_close": F.abs(F.col("distinct_count") - values) <= 0.1 * values + 1,
        # A value at a step of the distribution function has all the ranks of the step.
        "median_close": F.col("median").isNotNull() & (F.col("below") / n <= 0.51) & (F.col("upto") / n + 1 / n >= 0.49),
    })
    return flat(out, "window", "slice_key", "slice_value", "column_name", "distinct_close", "median_close")


@query(
    "d14_names_of_groups",
    f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, unnest(['window', 'granularity']) AS column_name,
        unnest([count(*), count(*)]) AS "count", unnest([{R('avg(value)')}, {R('avg(user_id)')}]) AS "avg" FROM events GROUP BY 1""",
)
def names_of_groups(spark, sf):
    """Monitored columns called like columns of the metric table."""
    df = table(spark, sf, "events").select("ts", F.col("value").alias("window"), F.col("user_id").alias("granularity"))
    rows = P.profile(df, MonitorSpec(TimeSeries("ts"), ("1 day",)))
    return flat(rows.where("column_name != ':table'"), "window", "column_name", "count", "avg")


# 2.D single metrics -----------------------------------------------------------

GENERIC = MonitorSpec(GenericTable())


@query(
    "d1_count_and_nulls",
    """WITH e AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
        CASE WHEN event_id % 10 <> 0 THEN value END AS value,
        nullif(event_type, 'click') AS event_type FROM events)
    SELECT window_start, 'value' AS column_name, count(*) AS "count",
        count(*) - count(value) AS num_nulls FROM e GROUP BY ALL
    UNION ALL SELECT window_start, 'event_type', count(*), count(*) - count(event_type)
    FROM e GROUP BY ALL""",
)
def count_and_nulls(spark, sf):
    events = table(spark, sf, "events").select(
        "ts",
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"),
        F.nullif("event_type", F.lit("click")).alias("event_type"),
    )
    spec = MonitorSpec(TimeSeries("ts"), granularities=("1 day",))
    rows = P.profile(events, spec).where("column_name != ':table'")
    return flat(rows, "window", "column_name", "count", "num_nulls")


@query(
    "d2_distinct",
    f"WITH {_YEAR_ROWS} "
    + " UNION ALL ".join(
        f"""SELECT {_KEYS}, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count,
        {R(f'count(DISTINCT {c}) / count({c})')} AS percent_distinct FROM rows_ GROUP BY ALL"""
        for c in (*_NUMBERS, *_TEXTS)
    ),
)
def distinct(spark, sf):
    spec = EVERYTHING.with_params(granularities=("1 year",))
    rows = P.profile(lineitem(spark, sf), spec).where("column_name != ':table'")
    return flat(
        rows, "window", "slice_key", "slice_value", "column_name", "distinct_count", "percent_distinct"
    )


@query(
    "d3_min_max",
    """SELECT 'c_acctbal' AS column_name, min(c_acctbal) AS "min", max(c_acctbal) AS "max" FROM customer
    UNION ALL SELECT 'c_nationkey', min(c_nationkey), max(c_nationkey) FROM customer
    UNION ALL SELECT 'c_custkey', min(c_custkey), max(c_custkey) FROM customer""",
)
def min_max(spark, sf):
    rows = P.profile(table(spark, sf, "customer"), GENERIC, as_of=AS_OF)
    return rows.where(F.col("min").isNotNull()).select("column_name", "min", "max")


@query(
    "d4_mean_and_stddev",
    f"""SELECT o_orderstatus AS slice_value, {R('avg(o_totalprice)', 4)} AS "avg",
        {R('stddev_samp(o_totalprice)', 4)} AS stddev FROM orders GROUP BY ALL
    UNION ALL SELECT NULL, {R('avg(o_totalprice)', 4)}, {R('stddev_samp(o_totalprice)', 4)} FROM orders""",
)
def mean_and_stddev(spark, sf):
    spec = GENERIC.with_params(slicing_exprs=("o_orderstatus",), columns=("o_totalprice",))
    rows = P.profile(table(spark, sf, "orders"), spec, as_of=AS_OF)
    rows = rows.where("column_name = 'o_totalprice'")
    return flat(rows, "slice_value", "avg", "stddev", digits=4)


@query(
    "d5_median_null_keys",
    """SELECT CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag END AS a, CASE WHEN l_orderkey % 2 = 1 THEN l_returnflag END AS b,
        quantile_disc(l_extendedprice, 0.5) AS median FROM lineitem GROUP BY 1, 2""",
)
def median_null_keys(spark, sf):
    """Groups whose keys hold the same value in another column, NULL in the rest."""
    even = F.col("l_orderkey") % 2 == 0
    rows = lineitem(spark, sf).select(
        F.when(even, F.col("l_returnflag")).alias("a"), F.when(~even, F.col("l_returnflag")).alias("b"), "l_extendedprice"
    )
    counts = materialize(C.value_counts(rows, ["a", "b"], ["l_extendedprice"]), "counts")
    return C.medians(counts, ["a", "b"]).select("a", "b", "median")


@query(
    "d5_median",
    """SELECT o_orderpriority AS slice_value, quantile_disc(o_totalprice, 0.5) AS median
    FROM orders GROUP BY ALL UNION ALL SELECT NULL, quantile_disc(o_totalprice, 0.5) FROM orders""",
)
def median(spark, sf):
    spec = GENERIC.with_params(slicing_exprs=("o_orderpriority",), columns=("o_totalprice",), exact=True)
    rows = P.group_rows(table(spark, sf, "orders"), spec, as_of=AS_OF)
    return order_statistics(rows, P.GROUP, ["o_totalprice"]).select("slice_value", "median")


@query(
    "d6_percent_zeros",
    f"""WITH {_YEAR_ROWS}
    SELECT window_start, slice_key, slice_value,
        {R('count(*) FILTER (l_discount = 0) / count(l_discount)')} AS percent_zeros
    FROM rows_ GROUP BY ALL""",
)
def percent_zeros(spark, sf):
    spec = YEARLY.with_params(columns=("l_discount",))
    rows = P.profile(lineitem(spark, sf), spec).where("column_name = 'l_discount'")
    return flat(rows, "window", "slice_key", "slice_value", "percent_zeros")


@query(
    "d7_average_length",
    f"""SELECT 'p_name' AS column_name, {R('avg(length(p_name))')} AS avg_length FROM part
    UNION ALL SELECT 'p_brand', {R('avg(length(p_brand))')} FROM part
    UNION ALL SELECT 'p_type', {R('avg(length(p_type))')} FROM part
    UNION ALL SELECT unnest(['p_partkey', 'p_size', 'p_retailprice']), NULL""",
)
def average_length(spark, sf):
    rows = P.profile(table(spark, sf, "part"), GENERIC, as_of=AS_OF)
    return flat(rows.where("column_name != ':table'"), "column_name", "avg_length")


@query(
    "d8_data_type",
    """SELECT column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
        WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' END AS data_type, n AS "count"
    FROM (SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS column_name,
        unnest([typeof(any_value(c_custkey)), typeof(any_value(c_name)), typeof(any_value(c_nationkey)),
            typeof(any_value(c_acctbal)), typeof(any_value(c_mktsegment))]) AS data_type,
        count(*) AS n FROM customer)""",
)
def data_type(spark, sf):
    spec = GENERIC.with_params(exact=False)
    rows = P.profile(table(spark, sf, "customer"), spec, as_of=AS_OF)
    return rows.where("column_name != ':table'").select("column_name", "data_type", "count")


@query(
    "d9_table_row",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, ':table' AS column_name,
        count(*) AS "count", 1 + (count(nullif(event_type, 'click')) > 0)::BIGINT
          + (count(CASE WHEN day(ts) <= 15 THEN value END) > 0)::BIGINT AS non_null_columns
    FROM events GROUP BY ALL""",
)
def table_row(spark, sf):
    events = table(spark, sf, "events").select(
        "ts",
        "user_id",
        F.nullif("event_type", F.lit("click")).alias("event_type"),
        F.when(F.dayofmonth("ts") <= 15, F.col("value")).alias("value"),
    )
    spec = MonitorSpec(TimeSeries("ts"), granularities=("1 day",), exact=False)
    rows = P.profile(events, spec).where("column_name = ':table'")
    return flat(rows, "window", "column_name", "count", "non_null_columns")


@query(
    "d10_category_counts",
    f"""WITH {_MONTH_ROWS}
    SELECT window_start, slice_key, slice_value, 'l_returnflag' AS column_name, l_returnflag AS value,
        count(*) AS n FROM rows_ GROUP BY ALL
    UNION ALL SELECT window_start, slice_key, slice_value, 'l_linestatus', l_linestatus, count(*)
    FROM rows_ GROUP BY ALL""",
)
def category_counts(spark, sf):
    spec = LINEITEM.with_params(columns=("l_returnflag", "l_linestatus"))
    counts = P.group_value_counts(lineitem(spark, sf), spec)
    return flat(
        counts.withColumnRenamed("txt", "value"),
        "window", "slice_key", "slice_value", "column_name", "value", "n",
    )


@query(
    "d11_slices",
    f"""SELECT CASE WHEN grouping(c_mktsegment) = 0 THEN 'c_mktsegment'
            WHEN grouping(c_acctbal > 0) = 0 THEN 'c_acctbal > 0' END AS slice_key,
        coalesce(c_mktsegment, CAST(c_acctbal > 0 AS VARCHAR)) AS slice_value,
        count(*) AS "count", {R('avg(c_acctbal)')} AS "avg"
    FROM customer GROUP BY GROUPING SETS ((), (c_mktsegment), (c_acctbal > 0))""",
)
def slices(spark, sf):
    rows = S.with_slices(table(spark, sf, "customer"), ["c_mktsegment", "c_acctbal > 0"])
    groups = rows.groupBy("slice_key", "slice_value")
    return groups.agg(F.count("*").alias("count"), rounded(F.avg("c_acctbal")).alias("avg"))


REGRESSION_LOG = InferenceLog(
    "o_orderdate", "prediction", "model_version", "regression",
    label_col="o_totalprice", example_id_col="o_orderkey", model_stage_col="o_orderstatus",
)


def order_log(spark, sf) -> DataFrame:
    """Orders as a regression log: the prediction is the customer's average price.

    The average is computed per customer and joined back, so a customer with a third of
    all orders is summed on the map side and never held in one task.
    """
    orders = table(spark, sf, "orders")
    mean = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("prediction"))
    version = (F.col("o_orderkey") % 2 + 1).cast("string")
    return orders.join(mean, "o_custkey").withColumn("model_version", version)


_ORDER_LOG = """
log_ AS (SELECT o.*, CAST(o_orderkey % 2 + 1 AS VARCHAR) AS model_version,
    strftime(date_trunc('year', o_orderdate), '%Y-%m-%d %H:%M:%S') AS window_start,
    avg(o_totalprice) OVER (PARTITION BY o_custkey) AS prediction FROM orders o)
"""


@query(
    "d12_versions_and_stages",
    f"""WITH {_ORDER_LOG}
    SELECT window_start, model_version, model_stage, 'o_totalprice' AS column_name,
        count(*) AS "count", {R('avg(o_totalprice)', 3)} AS "avg"
    FROM (SELECT * EXCLUDE (o_orderstatus), unnest([o_orderstatus, '*']) AS model_stage FROM log_)
    GROUP BY ALL""",
)
def versions_and_stages(spark, sf):
    spec = MonitorSpec(REGRESSION_LOG, ("1 year",), columns=("o_totalprice",), exact=False)
    rows = P.profile(order_log(spark, sf), spec).where("column_name = 'o_totalprice'")
    return flat(
        rows, "window", "model_version", "model_stage", "column_name", "count", "avg", digits=3
    )


def in_first_year(df: DataFrame) -> DataFrame:
    return df.where("l_shipdate < timestamp_ntz'1996-01-01 00:00:00'")


def first_year(spark, sf) -> DataFrame:
    return in_first_year(lineitem(spark, sf))


@query(
    "d13_log_types",
    f"""WITH {_YEAR_ROWS}
    SELECT 'INPUT' AS log_type, window_start, slice_key, slice_value, 'l_quantity' AS column_name,
        count(*) AS "count", {R('avg(l_quantity)')} AS "avg" FROM rows_ GROUP BY ALL
    UNION ALL
    SELECT 'BASELINE', NULL, slice_key, slice_value, 'l_quantity', count(*), {R('avg(l_quantity)')}
    FROM rows_ WHERE window_start < '1996' GROUP BY ALL""",
)
def log_types(spark, sf):
    spec = YEARLY.with_params(columns=("l_quantity",), exact=False)
    rows = P.profile(lineitem(spark, sf), spec).unionByName(
        P.profile(first_year(spark, sf), spec, BASELINE)
    )
    return flat(
        rows.where("column_name = 'l_quantity'"),
        "log_type", "window", "slice_key", "slice_value", "column_name", "count", "avg",
    )


# 2.E drift ---------------------------------------------------------------------


def _drift_sql(kind: str, numeric: bool) -> str:
    """CTEs ``pairs`` and ``pts`` (value, n_cur, n_base per pair) for one drift type."""
    cmp = (
        "'1995-01-01 00:00:00'"
        if kind == "BASELINE"
        else "lag(window_start) OVER (PARTITION BY slice_key, slice_value, column_name ORDER BY window_start)"
    )
    cols = ("l_quantity", "l_extendedprice", "l_discount") if numeric else ("l_returnflag", "l_linestatus")
    vals = " UNION ALL ".join(
        f"SELECT window_start, slice_key, slice_value, '{c}' AS column_name, {c} AS v FROM rows_" for c in cols
    )
    return f"""{_YEAR_ROWS},
    cnt AS (SELECT *, count(*) AS n FROM ({vals}) GROUP BY ALL),
    pairs AS (SELECT * FROM (SELECT *, {cmp} AS cmp FROM
        (SELECT DISTINCT window_start, slice_key, slice_value, column_name FROM cnt)) WHERE cmp IS NOT NULL),
    both_ AS (SELECT p.window_start, p.cmp, p.slice_key, p.slice_value, p.column_name, v, n AS a, 0 AS b
        FROM cnt c JOIN pairs p ON c.window_start = p.window_start AND c.column_name = p.column_name
          AND c.slice_key IS NOT DISTINCT FROM p.slice_key AND c.slice_value IS NOT DISTINCT FROM p.slice_value
      UNION ALL SELECT p.window_start, p.cmp, p.slice_key, p.slice_value, p.column_name, v, 0, n
        FROM cnt c JOIN pairs p ON c.window_start = p.cmp AND c.column_name = p.column_name
          AND c.slice_key IS NOT DISTINCT FROM p.slice_key AND c.slice_value IS NOT DISTINCT FROM p.slice_value),
    pts AS (SELECT window_start, cmp, slice_key, slice_value, column_name, v,
        sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM both_ GROUP BY ALL),
    tot AS (SELECT *, sum(a) OVER p AS ta, sum(b) OVER p AS tb FROM pts
        WINDOW p AS (PARTITION BY window_start, slice_key, slice_value, column_name))"""


def _cmp_out(kind: str) -> str:
    out = "NULL" if kind == "BASELINE" else "cmp"
    return f"'{kind}' AS drift_type, window_start, {out} AS window_cmp_start, slice_key, slice_value, column_name"


def _ks_sql(kind: str) -> str:
    lam = "(d * sqrt(ta * tb / (ta + tb)))"
    series = f"""2 * list_sum(list_transform(range(1, 101),
        lambda j: CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * {lam} * {lam})))"""
    return f"""SELECT * FROM (WITH {_drift_sql(kind, True)},
    run AS (SELECT *, sum(a) OVER w / ta AS fa, sum(b) OVER w / tb AS fb FROM tot
        WINDOW w AS (PARTITION BY window_start, slice_key, slice_value, column_name ORDER BY v)),
    ks AS (SELECT window_start, cmp, slice_key, slice_value, column_name, ta, tb,
        max(abs(fa - fb)) AS d FROM run GROUP BY ALL)
    SELECT {_cmp_out(kind)}, {R('d')} AS ks_statistic,
        {R(f'CASE WHEN {lam} < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, {series})) END')} AS ks_pvalue
    FROM ks)"""


def _cat_sql(kind: str, digits: int = 6) -> str:
    return f"""SELECT * FROM (WITH {_drift_sql(kind, False)},
    e AS (SELECT *, (a + b) * ta / (ta + tb) AS ea, (a + b) * tb / (ta + tb) AS eb FROM tot)
    SELECT {_cmp_out(kind)},
        {R('sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb)', digits)} AS chi_squared_statistic,
        count(*) - 1 AS chi_squared_dof, {R('0.5 * sum(abs(a / ta - b / tb))')} AS tv_distance
    FROM e GROUP BY window_start, cmp, slice_key, slice_value, column_name)"""


def _pairs(spark, sf, spec, df=None):
    """(kind, current counts, base counts, base keys, analysis pairs) for both drift types."""
    df = lineitem(spark, sf) if df is None else df
    counts = materialize(P.group_value_counts(df, spec), "counts")
    pairs = materialize(D.window_pairs(counts), "pairs")
    base = materialize(P.group_value_counts(in_first_year(df), spec, BASELINE), "counts")
    cur, previous = D.previous_counts(counts, pairs)
    none = F.lit(None).cast(counts.schema["window"].dataType)
    return [
        ("BASELINE", counts, base, [*D._BASE_KEYS, "column_name"], None, none),
        ("CONSECUTIVE", cur, previous, [*P.GROUP, "column_name"], pairs, None),
    ]


def _distance_rows(spark, sf, columns, measure, metrics):
    spec = YEARLY.with_params(columns=columns)
    out = []
    for kind, cur, base, base_keys, pairs, none in _pairs(spark, sf, spec):
        rows = measure(cur, base, base_keys, [*P.GROUP, "column_name"])
        if pairs is None:
            rows = rows.withColumn("window_cmp", none)
        else:
            rows = D.join_null_safe(rows, pairs, [c for c in pairs.columns if c != "window_cmp"])
        rows = rows.withColumn("drift_type", F.lit(kind))
        out.append(
            flat(rows, "drift_type", "window", "window_cmp", "slice_key", "slice_value", "column_name", *metrics)
        )
    return out[0].unionByName(out[1])


@query("e6_ks_test", _ks_sql("BASELINE") + " UNION ALL " + _ks_sql("CONSECUTIVE"))
def ks_test(spark, sf):
    columns = ("l_quantity", "l_extendedprice", "l_discount")
    return _distance_rows(spark, sf, columns, D.ks_statistics, ["ks_statistic", "ks_pvalue"])


@query(
    "e6_ks_test_of_sketches",
    f"SELECT * EXCLUDE (ks_statistic, ks_pvalue), true AS close FROM ({_ks_sql('BASELINE')} UNION ALL {_ks_sql('CONSECUTIVE')})",
)
def ks_test_of_sketches(spark, sf):
    """The statistic from the windows' sketches, next to the exact one."""
    exact = ks_test(spark, sf)
    spec = SKETCHED.with_params(granularities=("1 year",), columns=("l_quantity", "l_extendedprice", "l_discount"))
    rows = P.profile(lineitem(spark, sf), spec).where("column_name != ':table'")
    base = P.profile(first_year(spark, sf), spec, BASELINE).where("column_name != ':table'")
    keys = ["drift_type", "window_start", "window_cmp_start", "slice_key", "slice_value", "column_name"]
    none = F.lit(None).cast(rows.schema["window"].dataType)
    found = [
        D.select_pair(D.pair_with_baseline(rows, base), BASELINE, none, spec),
        D.select_pair(D.pair_with_previous(rows), "CONSECUTIVE", F.col("cur.window_cmp"), spec),
    ]
    near = flat(found[0].unionByName(found[1]), *["drift_type", "window", "window_cmp", *keys[3:], "ks_statistic"])
    joined = D.join_null_safe(exact, near.withColumnRenamed("ks_statistic", "near"), keys)
    return joined.select(*keys, (F.abs(F.col("near") - F.col("ks_statistic")) <= D.SKETCH_ERROR).alias("close"))


def _drop_tv(sql: str) -> str:
    return f"SELECT * EXCLUDE (tv_distance) FROM ({sql})"


@query("e7_chi_squared", _drop_tv(_cat_sql("BASELINE") + " UNION ALL " + _cat_sql("CONSECUTIVE")))
def chi_squared(spark, sf):
    def measure(*args):
        return D.category_tests(*args, pvalue=False)

    metrics = ["chi_squared_statistic", "chi_squared_dof"]
    return _distance_rows(spark, sf, ("l_returnflag", "l_linestatus"), measure, metrics)


def _pvalue_sql(kind: str) -> str:
    tail = chi2_tail_sql(f"chi_squared_statistic - {SHIFT}", "chi_squared_dof")
    return f"""SELECT * EXCLUDE (chi_squared_dof, tv_distance) REPLACE (round(chi_squared_statistic, 6) AS chi_squared_statistic),
        {R(tail)} AS chi_squared_pvalue FROM ({_cat_sql(kind, 14)})"""


@query("e7_chi_squared_pvalue", _pvalue_sql("BASELINE") + " UNION ALL " + _pvalue_sql("CONSECUTIVE"))
def chi_squared_pvalue(spark, sf):
    metrics = ["chi_squared_statistic", "chi_squared_pvalue"]
    return _distance_rows(spark, sf, ("l_returnflag", "l_linestatus"), D.category_tests, metrics)


@query(
    "e8_total_variation",
    "SELECT * EXCLUDE (chi_squared_statistic, chi_squared_dof) FROM ("
    + _cat_sql("BASELINE") + " UNION ALL " + _cat_sql("CONSECUTIVE") + ")",
)
def total_variation(spark, sf):
    def measure(*args):
        return D.category_tests(*args, pvalue=False)

    return _distance_rows(spark, sf, ("l_returnflag", "l_linestatus"), measure, ["tv_distance"])


def _texts(spark, sf) -> DataFrame:
    """Rows with a text of few values, one of many and one that is almost unique."""
    part = F.concat(F.lit("part "), "l_partkey").alias("part")
    row = F.concat_ws("/", "l_orderkey", "l_linenumber").alias("row")
    return lineitem(spark, sf).select("l_shipdate", "l_quantity", "l_returnflag", part, row)


def _texts_sql(kind: str) -> str:
    """Exact tests of the three texts, and what their bounds from classes are to say."""
    sql = _cat_sql(kind)
    values = {"l_returnflag": "l_returnflag", "part": "concat('part ', l_partkey)", "row": "concat(l_orderkey, '/', l_linenumber)"}
    mine = " UNION ALL ".join(
        f"SELECT window_start, slice_key, slice_value, '{c}' AS column_name, {v} AS v FROM rows_" for c, v in values.items()
    )
    given = " UNION ALL ".join(
        f"SELECT window_start, slice_key, slice_value, '{c}' AS column_name, {c} AS v FROM rows_" for c in _TEXTS
    )
    assert given in sql
    return f"""SELECT drift_type, window_start, window_cmp_start, slice_key, slice_value, column_name, tv_distance,
        true AS tv_within, true AS chi_squared_below, CASE WHEN column_name = 'l_returnflag' THEN true END AS exact FROM ({sql.replace(given, mine)})"""


@query("e8_total_variation_of_classes", _texts_sql("BASELINE") + " UNION ALL " + _texts_sql("CONSECUTIVE"))
def total_variation_of_classes(spark, sf):
    """Bounds from counts of classes around the exact distances, of texts of many values.

    ``exact`` is whether the bounds of the text of few values meet.
    """
    found = []
    for exact in (True, False):
        spec = YEARLY.with_params(columns=("l_returnflag", "part", "row"), exact=exact)
        for kind, cur, base, base_keys, pairs, none in _pairs(spark, sf, spec, _texts(spark, sf)):
            keys = [*P.GROUP, "column_name"]
            rows = D.category_tests(cur, base, base_keys, keys, pvalue=False).withColumn("drift_type", F.lit(kind))
            if pairs is None:
                rows = rows.withColumn("window_cmp", none)
            else:
                rows = D.join_null_safe(rows, pairs, [c for c in pairs.columns if c != "window_cmp"])
            found.append(rows)
    keys = ["drift_type", "window", "window_cmp", "slice_key", "slice_value", "column_name"]
    both = [found[i].unionByName(found[i + 1]) for i in (0, 2)]
    near = both[1].select(
        *keys, F.col("chi_squared_statistic").alias("chi"), F.col("tv_distance").alias("least"), F.col("tv_distance_max").alias("most")
    )
    rows = D.join_null_safe(both[0], near, keys)
    slack = F.lit(1e-9)
    within = (F.col("least") <= F.col("tv_distance") + slack) & (F.col("tv_distance") <= F.col("most") + slack)
    return flat(
        rows.withColumns(
            {
                "tv_within": within,
                "chi_squared_below": F.col("chi") <= F.col("chi_squared_statistic") * (1 + slack) + slack,
                "exact": F.when(F.col("column_name") == "l_returnflag", F.col("most") - F.col("least") <= slack),
            }
        ),
        *keys, "tv_distance", "tv_within", "chi_squared_below", "exact",
    )


_YEAR_AVG = f"""{_YEAR_ROWS},
m AS (SELECT window_start, slice_key, slice_value, count(*) AS n, avg(l_discount) AS mean,
    count(*) FILTER (l_discount = 0) / count(*) AS zeros, count(DISTINCT l_discount) / count(*) AS dist
    FROM rows_ GROUP BY ALL)"""


@query(
    "c11_pair_with_baseline",
    f"""WITH {_YEAR_AVG}
    SELECT c.window_start, c.slice_key, c.slice_value, 'l_discount' AS column_name,
        {R('c.mean')} AS "avg", {R('b.mean')} AS base_avg, b.n AS base_count
    FROM m c JOIN m b ON b.window_start = '1995-01-01 00:00:00'
      AND c.slice_key IS NOT DISTINCT FROM b.slice_key AND c.slice_value IS NOT DISTINCT FROM b.slice_value""",
)
def pair_with_baseline(spark, sf):
    spec = YEARLY.with_params(columns=("l_discount",), exact=False)
    cur = P.profile(lineitem(spark, sf), spec).where("column_name = 'l_discount'")
    pairs = D.pair_with_baseline(cur, P.profile(first_year(spark, sf), spec, BASELINE))
    return pairs.select(
        stamp(F.col("cur.window.start")).alias("window_start"),
        "cur.slice_key", "cur.slice_value", "cur.column_name",
        rounded(F.col("cur.avg")).alias("avg"),
        rounded(F.col("base.avg")).alias("base_avg"),
        F.col("base.count").alias("base_count"),
    )


@query(
    "c12_pair_with_previous",
    f"""WITH {_YEAR_AVG}
    SELECT window_start, slice_key, slice_value, 'l_discount' AS column_name, {R('mean')} AS "avg",
        cmp AS window_cmp_start, {R('base')} AS base_avg
    FROM (SELECT *, lag(window_start) OVER s AS cmp, lag(mean) OVER s AS base FROM m
          WINDOW s AS (PARTITION BY slice_key, slice_value ORDER BY window_start))
    WHERE cmp IS NOT NULL""",
)
def pair_with_previous(spark, sf):
    spec = YEARLY.with_params(columns=("l_discount",), exact=False)
    cur = P.profile(lineitem(spark, sf), spec).where("column_name = 'l_discount'")
    return D.pair_with_previous(cur).select(
        stamp(F.col("cur.window.start")).alias("window_start"),
        stamp(F.col("base.window.start")).alias("window_cmp_start"),
        "cur.slice_key", "cur.slice_value", "cur.column_name",
        rounded(F.col("cur.avg")).alias("avg"),
        rounded(F.col("base.avg")).alias("base_avg"),
    )


@query(
    "e1_fixed_windows",
    """SELECT g AS granularity, strftime(CASE g
          WHEN '30 minutes' THEN time_bucket(INTERVAL 30 MINUTE, ts) WHEN '1 hour' THEN date_trunc('hour', ts)
          WHEN '1 day' THEN date_trunc('day', ts) ELSE date_trunc('week', ts) END, '%Y-%m-%d %H:%M:%S') AS window_start,
        count(*) AS n
    FROM events, (SELECT unnest(['30 minutes', '1 hour', '1 day', '1 week']) AS g) GROUP BY ALL""",
)
def fixed_windows(spark, sf):
    rows = W.assign_windows(
        table(spark, sf, "events").select("ts"), "ts", ["30 minutes", "1 hour", "1 day", "1 week"]
    )
    groups = rows.groupBy("granularity", stamp(F.col("window.start")).alias("window_start"))
    return groups.agg(F.count("*").alias("n"))


@query(
    "e2_calendar_windows",
    """WITH m AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) - 1 AS i FROM lineitem),
    b AS (SELECT g, k, i - i % k AS s FROM m, (VALUES ('1 month', 1), ('3 months', 3), ('1 year', 12), ('2 years', 24)) v(g, k))
    SELECT g AS granularity, strftime(make_date(s // 12, s % 12 + 1, 1), '%Y-%m-%d %H:%M:%S') AS window_start,
        strftime(make_date((s + k) // 12, (s + k) % 12 + 1, 1), '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS n
    FROM b GROUP BY ALL""",
)
def calendar_windows(spark, sf):
    rows = W.assign_windows(
        lineitem(spark, sf).select("l_shipdate"),
        "l_shipdate",
        ["1 month", "3 months", "1 year", "2 years"],
    )
    groups = rows.groupBy(
        "granularity",
        stamp(F.col("window.start")).alias("window_start"),
        stamp(F.col("window.end")).alias("window_end"),
    )
    return groups.agg(F.count("*").alias("n"))


def customer_refreshes(spark, sf, spec) -> DataFrame:
    """Two refreshes of the customer table: before and after new rows arrive."""
    customer = table(spark, sf, "customer")
    return P.profile(customer.where("c_custkey % 3 != 0"), spec, as_of=AS_OF).unionByName(
        P.profile(customer, spec, as_of=AS_OF + dt.timedelta(days=1))
    )


@query(
    "e3_snapshot_windows",
    f"""SELECT '2024-02-01 00:00:00' AS window_start, 'c_acctbal' AS column_name, count(*) AS "count",
        {R('avg(c_acctbal)')} AS "avg" FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT '2024-02-02 00:00:00', 'c_acctbal', count(*), {R('avg(c_acctbal)')} FROM customer""",
)
def snapshot_windows(spark, sf):
    spec = GENERIC.with_params(columns=("c_acctbal",), exact=False)
    rows = customer_refreshes(spark, sf, spec).where("column_name = 'c_acctbal'")
    return flat(rows, "window", "column_name", "count", "avg")


@query(
    "e4_previous_window",
    """WITH w AS (SELECT DISTINCT event_type, date_trunc('minute', ts) AS s FROM events)
    SELECT * FROM (SELECT event_type AS slice_value, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start,
        strftime(lag(s) OVER (PARTITION BY event_type ORDER BY s), '%Y-%m-%d %H:%M:%S') AS window_cmp_start
        FROM w) WHERE window_cmp_start IS NOT NULL""",
)
def previous_window(spark, sf):
    """Sparse windows of a minute: the one before is the last that has rows."""
    rows = W.assign_windows(table(spark, sf, "events"), "ts", ["1 minute"])
    pairs = D.window_pairs(rows.withColumnRenamed("event_type", "slice_value"), ["granularity", "slice_value"])
    return flat(pairs, "slice_value", "window", "window_cmp")


@query(
    "e5_numeric_deltas",
    f"""WITH {_YEAR_AVG}
    SELECT window_start, slice_key, slice_value, 'l_discount' AS column_name, n - bn AS count_delta,
        {R('mean - bmean')} AS avg_delta, {R('zeros - bzeros')} AS percent_zeros_delta,
        {R('dist - bdist')} AS percent_distinct_delta, {R('0.0')} AS percent_null_delta
    FROM (SELECT *, lag(n) OVER s AS bn, lag(mean) OVER s AS bmean, lag(zeros) OVER s AS bzeros,
          lag(dist) OVER s AS bdist FROM m
          WINDOW s AS (PARTITION BY slice_key, slice_value ORDER BY window_start)) WHERE bn IS NOT NULL""",
)
def numeric_deltas(spark, sf):
    spec = YEARLY.with_params(columns=("l_discount",))
    cur = P.profile(lineitem(spark, sf), spec).where("column_name = 'l_discount'")
    joined = D.pair_with_previous(cur)
    rows = joined.select("cur.window", "cur.slice_key", "cur.slice_value", "cur.column_name", *D.metric_deltas(joined, spec))
    return flat(
        rows, "window", "slice_key", "slice_value", "column_name", "count_delta", "avg_delta",
        "percent_zeros_delta", "percent_distinct_delta", "percent_null_delta",
    )
