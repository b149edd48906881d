"""Thresholds, bootstrap, sampling, set operations and reshaping."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import LADDER_UPTO, POISSON_CDF, poisson, poisson_draws
from tidemark.functions.stats import t_exact
from tidemark.operators import bootstrap as B
from tidemark.operators import profile as P
from tidemark.operators import reshape, sampling, setops
from tidemark.operators import thresholds as TH
from tidemark.operators.running import positions
from tidemark.queries.monitoring import R, flat, rounded
from tidemark.queries.registry import dealt, query, table
from tidemark.session import materialize
from tidemark.spec import MonitorSpec, TimeSeries

CONFIDENCE = 0.95
REPLICATES = 50

# SQL: the same draws as in tidemark.functions.draws.
_POISSON_SQL = "CASE " + " ".join(
    f"WHEN v <= {math.floor(p * 2**32)} THEN {k}" for k, p in enumerate(POISSON_CDF)
) + f" ELSE {len(POISSON_CDF)} END"


def _draws_sql(key: str, source: str, columns: str) -> str:
    return f"""SELECT *, {_POISSON_SQL} AS w FROM (
        SELECT {columns}, i AS replicate, concat('0x', substr(md5(concat({key}, '-', i // 4)), 1 + 8 * (i % 4), 8))::UBIGINT AS v
        FROM {source}, (SELECT unnest(range({REPLICATES})) AS i))"""


def _share_sql(text: str, place: str = "0") -> str:
    return f"(concat('0x', substr({text}, 1 + 8 * ({place}), 8))::UBIGINT / 4294967296.0)"


def _uniform_sql(key: str, number: str = "'0'") -> str:
    return _share_sql(f"md5(concat({key}, '-', {number}))")


_Z = NormalDist().inv_cdf(0.975)


def _t_sql(dof: str) -> str:
    z = _Z
    g = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    terms = " + ".join(f"{x!r}::DOUBLE / ({dof}) ** {i + 1}" for i, x in enumerate(g))
    return f"({z!r}::DOUBLE + {terms})"


def orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders")


@query(
    "i1_poisson_counts",
    f"""SELECT replicate, w AS weight, count(*) AS n FROM ({_draws_sql('o_orderkey', 'orders', 'o_orderkey')})
    GROUP BY ALL""",
)
def poisson_counts(spark, sf):
    drawn = poisson_draws(orders(spark, sf).select("o_orderkey"), F.col("o_orderkey"), REPLICATES)
    return drawn.groupBy("replicate", "weight").agg(F.count("*").alias("n"))


_REPLICATE_SQL = f"""SELECT replicate, sum(w)::BIGINT AS n, {R('sum(w * o_totalprice) / sum(w)', 3)} AS "avg",
    {R('sqrt((sum(w * o_totalprice * o_totalprice) - sum(w * o_totalprice) ** 2 / sum(w)) / (sum(w) - 1))', 3)} AS stddev
    FROM ({_draws_sql('o_orderkey', 'orders', 'o_totalprice')}) GROUP BY replicate"""


@query("i2_bootstrap_by_copies", _REPLICATE_SQL)
def bootstrap_by_copies(spark, sf):
    reps = B.bootstrap_by_copies(orders(spark, sf), "o_totalprice", REPLICATES, F.col("o_orderkey"))
    return flat(reps, "replicate", "n", "avg", "stddev", digits=3)


@query("i3_weighted_bootstrap", f"SELECT * EXCLUDE (n) FROM ({_REPLICATE_SQL})")
def weighted_bootstrap(spark, sf):
    stats = {"o_totalprice": ["avg", "stddev"]}
    reps = B.bootstrap(orders(spark, sf), stats, REPLICATES, F.col("o_orderkey"))
    wide = reps.groupBy("replicate").pivot("metric", ["avg", "stddev"]).agg(F.first("value"))
    return flat(wide, "replicate", "avg", "stddev", digits=3)


@query("i4_array_of_draws", f"SELECT * EXCLUDE (stddev) FROM ({_REPLICATE_SQL})")
def array_of_draws(spark, sf):
    """All draws of a row in one array column, then taken apart by position."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.lit((REPLICATES - 1) // 4)),
        lambda i: F.md5(F.concat_ws("-", F.col("o_orderkey").cast("string"), i.cast("string"))),
    )
    draws = F.flatten(
        F.transform(hashes, lambda h: F.array(*[poisson(F.substring(h, 1 + 8 * i, 8)) for i in range(4)]))
    )
    rows = orders(spark, sf).select("o_totalprice", F.slice(draws, 1, REPLICATES).alias("draws"))
    long = rows.select("o_totalprice", F.posexplode("draws").alias("replicate", "w"))
    mean = F.sum(F.col("w") * F.col("o_totalprice")) / F.sum("w")
    return long.groupBy("replicate").agg(F.sum("w").alias("n"), rounded(mean, 3).alias("avg"))


def _interval_sql(value: str, reps: str, pad: int = 1) -> str:
    return f"""SELECT max({value}) FILTER (rk = {pad}) AS low, max({value}) FILTER (rk = {REPLICATES - pad}) AS high
        FROM (SELECT *, row_number() OVER (ORDER BY {value}) AS rk FROM ({reps}))"""


@query(
    "i5_percentile_interval",
    f"""SELECT 'avg' AS metric, 'o_totalprice' AS column_name, * FROM ({_interval_sql('"avg"', _REPLICATE_SQL)})
    UNION ALL SELECT 'stddev', 'o_totalprice', * FROM ({_interval_sql('stddev', _REPLICATE_SQL)})""",
)
def percentile_interval(spark, sf):
    stats = {"o_totalprice": ["avg", "stddev"]}
    reps = B.bootstrap(orders(spark, sf), stats, REPLICATES, F.col("o_orderkey"))
    out = B.percentile_interval(reps, CONFIDENCE, REPLICATES)
    return flat(out, "metric", "column_name", "low", "high", digits=3)


def _mean_sql(c: str, source: str, n: str = "count({c})", digits: int = 6) -> str:
    n = n.format(c=c)
    b = f"{_t_sql(f'({n} - 1)')} * stddev_samp({c}) / sqrt({n})"
    return f"""SELECT 'avg' AS metric, 0.95::DOUBLE AS interval_width, '{c}' AS column_name,
        {R(f'avg({c}) - {b}', digits)} AS low, {R(f'avg({c}) + {b}', digits)} AS high FROM {source}"""


@query(
    "i6_mean_interval",
    " UNION ALL ".join(_mean_sql(c, "lineitem", digits=5) for c in ("l_quantity", "l_discount", "l_tax")),
)
def mean_interval(spark, sf):
    out = TH.mean_interval(
        table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], CONFIDENCE
    )
    return flat(out, *TH.COLUMNS, digits=5)


@query(
    "i7_expected_size",
    _mean_sql("l_quantity", "lineitem", "500") + " UNION ALL "
    + _mean_sql("l_discount", "lineitem", "least(count({c}), 1000000000)"),
)
def expected_size(spark, sf):
    df = table(spark, sf, "lineitem")
    a = TH.mean_interval(df, ["l_quantity"], CONFIDENCE, expected_n=500)
    b = TH.mean_interval(df, ["l_discount"], CONFIDENCE, expected_n=1_000_000_000, at_most=True)
    return flat(a.unionByName(b), *TH.COLUMNS)


def _median_sql(c: str, source: str) -> str:
    return f"""SELECT 'median' AS metric, 0.95::DOUBLE AS interval_width, '{c}' AS column_name,
        max({c}) FILTER (rk = greatest(1, ceil(n / 2 - b))) AS low, max({c}) FILTER (rk = least(n, ceil(n / 2 + b))) AS high
        FROM (SELECT {c}, n, rk, {_t_sql('(n - 1)')} * sqrt(n / 4) AS b
              FROM (SELECT {c}, count(*) OVER () AS n, row_number() OVER (ORDER BY {c}) AS rk FROM {source} WHERE {c} IS NOT NULL))"""


@query(
    "i8_median_interval",
    _median_sql("o_totalprice", "orders") + " UNION ALL " + _median_sql("half", "(SELECT CASE WHEN o_custkey % 2 = 0 THEN o_totalprice END AS half FROM orders)"),
)
def median_interval(spark, sf):
    df = orders(spark, sf).withColumn("half", F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice")))
    return TH.median_interval(df, ["o_totalprice", "half"], CONFIDENCE)


_ORDER_STATS = f"""SELECT replicate, sqrt((sum(w * o_totalprice * o_totalprice) - sum(w * o_totalprice) ** 2 / sum(w)) / (sum(w) - 1)) AS sd,
    sum(w * length(o_orderpriority)) / sum(w) AS len FROM ({_draws_sql('o_orderkey', 'orders', 'o_totalprice, o_orderpriority')}) GROUP BY replicate"""


@query(
    "i9_generated_thresholds",
    _mean_sql("o_totalprice", "orders", digits=3) + f"""
    UNION ALL SELECT metric, interval_width, column_name, {R('low', 3)}, {R('high', 3)} FROM ({_median_sql('o_totalprice', 'orders')})
    UNION ALL SELECT 'stddev', 0.95, 'o_totalprice', {R('low', 3)}, {R('high', 3)} FROM ({_interval_sql('sd', _ORDER_STATS)})
    UNION ALL SELECT 'avg_length', 0.95, 'o_orderpriority', {R('low', 3)}, {R('high', 3)} FROM ({_interval_sql('len', _ORDER_STATS)})""",
)
def generated_thresholds(spark, sf):
    """One call for several columns; avg_length does not apply to a number."""
    out = TH.generate_thresholds(
        orders(spark, sf),
        {"o_totalprice": ["avg", "median", "stddev", "avg_length"], "o_orderpriority": ["avg_length"]},
        F.col("o_orderkey"),
        CONFIDENCE,
        REPLICATES,
    )
    return flat(out, *TH.COLUMNS, digits=3)


_CAT_REPS = f"""
draws AS ({_draws_sql('o_orderkey', 'orders', 'o_orderstatus, o_totalprice')}),
reps AS (SELECT replicate, o_orderstatus AS v, sum(w)::DOUBLE AS a FROM draws GROUP BY ALL),
base AS (SELECT o_orderstatus AS v, count(*)::DOUBLE AS b FROM orders GROUP BY ALL),
both_ AS (SELECT replicate, a, b, sum(a) OVER (PARTITION BY replicate) AS ta, sum(b) OVER (PARTITION BY replicate) AS tb
    FROM reps JOIN base USING (v)),
dist AS (SELECT replicate, 0.5 * sum(abs(a / ta - b / tb)) AS tv,
    sum((a - (a + b) * ta / (ta + tb)) ** 2 / ((a + b) * ta / (ta + tb)) + (b - (a + b) * tb / (ta + tb)) ** 2 / ((a + b) * tb / (ta + tb))) AS chi
    FROM both_ GROUP BY replicate),
num AS (SELECT replicate, o_totalprice AS v, sum(w)::DOUBLE AS a, count(*)::DOUBLE AS b FROM draws GROUP BY ALL),
cum AS (SELECT replicate, sum(a) OVER w / sum(a) OVER (PARTITION BY replicate) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY replicate) AS fb
    FROM num WINDOW w AS (PARTITION BY replicate ORDER BY v)),
ks AS (SELECT replicate, max(abs(fa - fb)) AS d FROM cum GROUP BY replicate),
delta AS (SELECT replicate, sum(w * o_totalprice) / sum(w) - (SELECT avg(o_totalprice) FROM orders) AS x FROM draws GROUP BY replicate)"""


def _top_sql(metric: str, column: str, value: str, source: str) -> str:
    pad = math.floor(round(0.05 * REPLICATES, 9))
    return f"""SELECT '{metric}' AS metric, 0.95::DOUBLE AS interval_width, '{column}' AS column_name, 0.0::DOUBLE AS low,
        {R(f'max({value})', 5)} AS high FROM (SELECT {value}, row_number() OVER (ORDER BY {value}) AS rk FROM {source}) WHERE rk <= {REPLICATES - pad}"""


@query(
    "i10_drift_thresholds",
    f"""WITH {_CAT_REPS}
    {_top_sql('chi_squared_test', 'o_orderstatus', 'chi', 'dist')} UNION ALL {_top_sql('tv_distance', 'o_orderstatus', 'tv', 'dist')}
    UNION ALL {_top_sql('ks_test', 'o_totalprice', 'd', 'ks')}
    UNION ALL SELECT 'avg_delta', 0.95, 'o_totalprice', {R('max(x) FILTER (rk = 1)', 5)}, {R(f'max(x) FILTER (rk = {REPLICATES - 1})', 5)}
        FROM (SELECT x, row_number() OVER (ORDER BY x) AS rk FROM delta)""",
)
def drift_thresholds(spark, sf):
    # Drawn from several times: dealt out once and written.
    rows = dealt(orders(spark, sf).select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
    out = TH.generate_thresholds(
        materialize(rows, "rows"),
        {
            "o_orderstatus": ["chi_squared_test", "tv_distance", "ks_test"],
            "o_totalprice": ["ks_test", "avg_delta"],
        },
        F.col("o_orderkey"),
        CONFIDENCE,
        REPLICATES,
        by_counts=False,
    )
    return flat(out, *TH.COLUMNS, digits=5)


def _poisson_of_sql(rows: str) -> str:
    """``w`` for rows of ``n`` and two draws ``u1``, ``u2``: the ladder, or the rounded normal."""
    return f"""SELECT *, CASE WHEN n > {LADDER_UPTO}
            THEN greatest(0.0, round(n + sqrt(n) * sqrt(-2 * ln(1 - u1)) * cos(2 * pi() * u2)))::BIGINT
            ELSE (SELECT count(*) FILTER (u1 >= below) FROM (SELECT sum(exp(-n + j * ln(n) - lgamma(j + 1))) OVER (ORDER BY j) AS below
                FROM (SELECT unnest(range(200)) AS j))) END AS w FROM ({rows})"""


def _count_reps_sql(column: str, value: str) -> str:
    return _poisson_of_sql(f"""SELECT r AS replicate, v, n, {_share_sql('h', '2 * (r % 2)')} AS u1, {_share_sql('h', '2 * (r % 2) + 1')} AS u2
        FROM (SELECT v, n::DOUBLE AS n, r, md5(concat_ws('-', '0', '{column}', {value}, r // 2)) AS h
            FROM (SELECT {column} AS v, count(*) AS n FROM lineitem GROUP BY 1), (SELECT unnest(range({REPLICATES})) AS r))""")


@query(
    "i10_drift_thresholds_from_counts",
    f"""WITH cat AS (SELECT replicate, w::DOUBLE AS a, n AS b, sum(w) OVER (PARTITION BY replicate)::DOUBLE AS ta, sum(n) OVER (PARTITION BY replicate) AS tb
        FROM ({_count_reps_sql('l_returnflag', 'v')})),
    dist AS (SELECT replicate, 0.5 * sum(abs(a / ta - b / tb)) AS tv,
        sum((a - (a + b) * ta / (ta + tb)) ** 2 / ((a + b) * ta / (ta + tb)) + (b - (a + b) * tb / (ta + tb)) ** 2 / ((a + b) * tb / (ta + tb))) AS chi
        FROM cat GROUP BY replicate),
    cum AS (SELECT replicate, sum(w) OVER o / sum(w) OVER p AS fa, sum(n) OVER o / sum(n) OVER p AS fb
        FROM ({_count_reps_sql('l_quantity', 'v::VARCHAR')}) WINDOW p AS (PARTITION BY replicate), o AS (PARTITION BY replicate ORDER BY v)),
    ks AS (SELECT replicate, max(abs(fa - fb)) AS d FROM cum GROUP BY replicate)
    {_top_sql('chi_squared_test', 'l_returnflag', 'chi', 'dist')} UNION ALL {_top_sql('tv_distance', 'l_returnflag', 'tv', 'dist')}
    UNION ALL {_top_sql('ks_test', 'l_quantity', 'd', 'ks')}""",
)
def drift_thresholds_from_counts(spark, sf):
    """The same thresholds with value counts resampled: work by distinct values."""
    out = TH.generate_thresholds(
        table(spark, sf, "lineitem"),
        {"l_returnflag": ["chi_squared_test", "tv_distance"], "l_quantity": ["ks_test"]},
        F.col("l_orderkey"),
        CONFIDENCE,
        REPLICATES,
    )
    return flat(out, *TH.COLUMNS, digits=5)


_SIZES, _TRIALS = (100, 400), 20


@query(
    "i11_coverage",
    f"""WITH b AS ({_median_sql('o_totalprice', 'orders')}),
    d AS (SELECT o_totalprice AS x, t AS trial, row_number() OVER (PARTITION BY t ORDER BY {_share_sql("md5(concat(o_orderkey, '-', t // 4))", 't % 4')}, o_orderkey::VARCHAR) AS rk
        FROM orders, (SELECT unnest(range({_TRIALS})) AS t)),
    m AS (SELECT size, trial, median(x) AS m FROM d, (SELECT unnest([100, 400]) AS size) WHERE rk <= size GROUP BY ALL)
    SELECT size, {R('avg((m BETWEEN (SELECT low FROM b) AND (SELECT high FROM b))::INT)')} AS coverage FROM m GROUP BY size""",
)
def coverage(spark, sf):
    df = orders(spark, sf)
    bounds = TH.median_interval(df, ["o_totalprice"], CONFIDENCE)
    out = TH.coverage(df, "o_totalprice", bounds, F.col("o_orderkey"), _SIZES, _TRIALS)
    return flat(out, "size", "coverage")


_MONTHLY = """m AS (SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d %H:%M:%S') AS window_start, l_returnflag AS slice_value,
        avg(l_discount) AS x FROM lineitem GROUP BY GROUPING SETS ((1), (1, 2)))"""


@query(
    "i13_alerts",
    f"""WITH t AS ({_mean_sql('l_discount', "(SELECT * FROM lineitem WHERE l_shipdate < '1996-01-01')", digits=9)}), {_MONTHLY}
    SELECT window_start, 'l_discount' AS column_name, 'avg' AS metric, {R('x')} AS value, {R('low')} AS low, {R('high')} AS high,
        CASE WHEN x < low THEN 'below' ELSE 'above' END AS reason
    FROM m, t WHERE slice_value IS NULL AND NOT (x BETWEEN low AND high)""",
)
def alerts(spark, sf):
    """Months whose mean discount leaves the first year's interval."""
    df = table(spark, sf, "lineitem")
    first = df.where("l_shipdate < timestamp_ntz'1996-01-01 00:00:00'")
    bounds = TH.mean_interval(first, ["l_discount"], CONFIDENCE)
    spec = MonitorSpec(TimeSeries("l_shipdate"), ("1 month",), columns=("l_discount",))
    out = TH.alerts(P.profile(df, spec), bounds, ["avg"], ["window"])
    return flat(out, "window", "column_name", "metric", "value", "low", "high", "reason")


@query(
    "i13_alerts_by_slice",
    f"""WITH {_MONTHLY}, t AS (SELECT l_returnflag AS slice_value, avg(l_discount) AS low FROM lineitem GROUP BY 1
        UNION ALL SELECT NULL, NULL)
    SELECT window_start, slice_value, 'l_discount' AS column_name, {R('x')} AS value, {R('low')} AS low,
        CASE WHEN low IS NULL THEN 'no bounds' ELSE 'below' END AS reason
    FROM m JOIN t USING (slice_value) WHERE x < low
    UNION ALL SELECT window_start, NULL, 'l_discount', {R('x')}, NULL, 'no bounds' FROM m WHERE slice_value IS NULL""",
)
def alerts_by_slice(spark, sf):
    """A bound of each slice's own, open above; the whole table has none and says so."""
    df = table(spark, sf, "lineitem")
    spec = MonitorSpec(TimeSeries("l_shipdate"), ("1 month",), ("l_returnflag",), columns=("l_discount",))
    own = df.groupBy(F.col("l_returnflag").alias("slice_value")).agg(F.avg("l_discount").alias("low"))
    none = own.limit(1).select(F.lit(None).cast("string").alias("slice_value"), F.lit(None).cast("double").alias("low"))
    bounds = own.union(none).withColumns(
        {"metric": F.lit("avg"), "column_name": F.lit("l_discount"), "high": F.lit(None).cast("double")}
    )
    out = TH.alerts(P.profile(df, spec), bounds, ["avg"], ["window", "slice_value"], ["slice_value"])
    return flat(out, "window", "slice_value", "column_name", "value", "low", "reason")


@query(
    "i13_constant_limits",
    f"""SELECT strftime(date_trunc('year', o_orderdate), '%Y-%m-%d %H:%M:%S') AS window_start, 'o_totalprice' AS column_name,
        {R('avg(o_totalprice)', 2)} AS value, 'above' AS reason FROM orders GROUP BY 1 HAVING avg(o_totalprice) > 100000""",
)
def alerts_by_constant(spark, sf):
    """Years whose mean order is above a limit given by hand."""
    spec = MonitorSpec(TimeSeries("o_orderdate"), ("1 year",), columns=("o_totalprice",))
    limits = TH.constant_limits([("avg", "o_totalprice", None, 100_000.0)], spark)
    out = TH.alerts(P.profile(orders(spark, sf), spec), limits, ["avg"], ["window"])
    return flat(out.drop("low", "high", "metric"), "window", "column_name", "value", "reason", digits=2)


@query(
    "i9_thresholds_of_a_version",
    _mean_sql("o_totalprice", "(SELECT * FROM orders WHERE o_orderkey % 2 = 0)", digits=3),
)
def thresholds_of_a_version(spark, sf):
    df = orders(spark, sf).withColumn("model_version", (F.col("o_orderkey") % 2 + 1).cast("string"))
    out = TH.generate_thresholds(df, {"o_totalprice": ["avg"]}, F.col("o_orderkey"), CONFIDENCE, model_version="1")
    return flat(out, *TH.COLUMNS, digits=3)


_FEW = "(SELECT o_orderpriority, max(o_totalprice) AS x FROM orders GROUP BY o_orderpriority)"


@query(
    "i6_mean_interval_of_few",
    f"""SELECT 'avg' AS metric, 0.8::DOUBLE AS interval_width, 'x' AS column_name,
        {R('avg(x) - b', 3)} AS low, {R('avg(x) + b', 3)} AS high
    FROM (SELECT x, CASE count(*) OVER () {' '.join(f"WHEN {k + 1} THEN {t_exact(k, 0.8)!r}::DOUBLE" for k in range(1, 10))} END
        * stddev_samp(x) OVER () / sqrt(count(*) OVER ()) AS b FROM {_FEW}) GROUP BY b""",
)
def mean_interval_of_few(spark, sf):
    """A handful of values at a confidence that no table lists."""
    few = orders(spark, sf).groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("x"))
    return flat(TH.mean_interval(few, ["x"], 0.8), *TH.COLUMNS, digits=3)


@query(
    "i3_bootstrap_of_large_values",
    f"""WITH x AS (SELECT o_orderkey, epoch_ms(o_orderdate) + 1700000000000 AS x FROM orders), a AS (SELECT avg(x) AS m FROM x),
    d AS ({_draws_sql('o_orderkey', 'x', 'o_orderkey, x')})
    SELECT replicate, {R('sqrt((sum(w * (x - m) ** 2) - sum(w * (x - m)) ** 2 / sum(w)) / (sum(w) - 1)) / 1e6', 3)} AS stddev
    FROM d, a GROUP BY replicate, m""",
)
def bootstrap_of_large_values(spark, sf):
    """Spread of moments in milliseconds, whose squares would cancel."""
    df = orders(spark, sf).select(
        "o_orderkey", (F.unix_millis(F.col("o_orderdate").cast("timestamp")) + 1700000000000).alias("x")
    )
    reps = B.bootstrap(df, {"x": ["stddev"]}, REPLICATES, F.col("o_orderkey"))
    return reps.select("replicate", rounded(F.col("value") / 1e6, 3).alias("stddev"))


# 2.F ---------------------------------------------------------------------------


@query(
    "f1_multi_key_sort",
    """SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderpriority DESC, o_orderkey) AS position, o_orderkey
        FROM orders""",
)
def multi_key_sort(spark, sf):
    """All rows of a descending sort with their position."""
    order = [F.desc("o_orderdate"), F.desc("o_orderpriority"), F.asc("o_orderkey")]
    return positions(orders(spark, sf), order).select("position", "o_orderkey")


@query(
    "f2_fixed_size_sample",
    f"SELECT o_orderkey FROM orders ORDER BY {_uniform_sql('o_orderkey')}, o_orderkey::VARCHAR LIMIT 500",
)
def fixed_size_sample(spark, sf):
    return sampling.sample_rows(orders(spark, sf), 500, F.col("o_orderkey")).select("o_orderkey")


@query(
    "f3_fraction_sample",
    f"SELECT o_orderkey FROM orders WHERE {_uniform_sql('o_orderkey')} < least(1.0, 1.1 * 1000 / (SELECT count(*) FROM orders))",
)
def fraction_sample(spark, sf):
    return sampling.sample_about(orders(spark, sf), 1000, F.col("o_orderkey")).select("o_orderkey")


@query(
    "f4_weighted_split",
    f"""SELECT CASE WHEN u < 0.6 THEN 0 WHEN u < 0.8 THEN 1 ELSE 2 END AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys
    FROM (SELECT o_orderkey, {_uniform_sql('o_orderkey', "'42'")} AS u FROM orders) GROUP BY ALL""",
)
def weighted_split(spark, sf):
    parts = sampling.split(orders(spark, sf), [0.6, 0.2, 0.2], F.col("o_orderkey"), seed=42)
    tagged = [p.select(F.lit(i).alias("part"), "o_orderkey") for i, p in enumerate(parts)]
    return setops.union_positional(tagged).groupBy("part").agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")
    )


@query(
    "f5_top_groups",
    """SELECT source, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY source ORDER BY n DESC, source LIMIT 5""",
)
def top_groups(spark, sf):
    return sampling.top_groups(table(spark, sf, "documents").where("lang != 'en'"), ["source"], 5)


@query(
    "f6_best_threshold",
    """WITH g AS (SELECT t, avg((n_chars > t)::INT) FILTER (quality = 1) AS a, avg((n_chars <= t)::INT) FILTER (quality = 0) AS b
        FROM documents JOIN labels USING (doc_id), (SELECT unnest(range(100, 2100, 100)) AS t) GROUP BY t)
    SELECT arg_max(t, ((a + b) / 2, -t)) AS best_by_mean, arg_max(t, (least(a, b), -t)) AS best_by_min FROM g""",
)
def best_threshold(spark, sf):
    """Text length that separates good from bad documents best."""
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    grid = labelled.select("n_chars", "quality", F.explode(F.sequence(F.lit(100), F.lit(2000), F.lit(100))).alias("t"))
    good = F.avg(F.when(F.col("quality") == 1, (F.col("n_chars") > F.col("t")).cast("int")))
    bad = F.avg(F.when(F.col("quality") == 0, (F.col("n_chars") <= F.col("t")).cast("int")))
    scores = grid.groupBy("t").agg(good.alias("a"), bad.alias("b"))
    return sampling.best_threshold(scores, "t", "a", "b")


@query(
    "f7_listing_per_class",
    """SELECT p_type, p_name, p_partkey FROM part
    WHERE p_type IN (SELECT min(p_type) FROM part UNION ALL SELECT max(p_type) FROM part)""",
)
def listing_per_class(spark, sf):
    """Rows of chosen classes sorted by class and name; a large class spans many tasks."""
    part = table(spark, sf, "part")
    ends = part.agg(F.array(F.min("p_type"), F.max("p_type")).alias("ends")).select(F.explode("ends").alias("p_type"))
    chosen = part.join(ends, "p_type", "left_semi").select("p_type", "p_name", "p_partkey")
    return chosen.orderBy("p_type", "p_name", "p_partkey")


# 2.G, 2.H -------------------------------------------------------------------------


def _buckets(spark, sf, n: int) -> list[DataFrame]:
    df = orders(spark, sf).select("o_orderkey", "o_totalprice")
    return [df.where(F.col("o_orderkey") % n == i).withColumn("part", F.lit(i)) for i in range(n)]


@query(
    "g1_positional_union",
    f"""SELECT part, count(*) AS n, {R('sum(x)', 2)} AS total FROM (
        SELECT 0 AS part, o_totalprice AS x FROM orders UNION ALL SELECT 1, l_extendedprice FROM lineitem
        UNION ALL SELECT 2, c_acctbal FROM customer) GROUP BY part""",
)
def positional_union(spark, sf):
    frames = [
        table(spark, sf, t).select(F.lit(i).alias("part"), F.col(c).alias(f"x{i}"))
        for i, (t, c) in enumerate(
            [("orders", "o_totalprice"), ("lineitem", "l_extendedprice"), ("customer", "c_acctbal")]
        )
    ]
    return setops.union_positional(frames).groupBy("part").agg(
        F.count("*").alias("n"), rounded(F.sum("x0"), 2).alias("total")
    )


@query(
    "g2_union_by_name",
    """SELECT 'customer' AS kind, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""",
)
def union_by_name(spark, sf):
    a = table(spark, sf, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
    )
    b = table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key")
    )
    return setops.union_all([a, b], allow_missing=True)


@query(
    "g3_balanced_union",
    f"SELECT (o_orderkey % 13)::INT AS part, count(*) AS n, {R('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY ALL",
)
def balanced_union(spark, sf):
    united = setops.union_balanced(_buckets(spark, sf, 13))
    return united.groupBy("part").agg(F.count("*").alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))


_WIDE_SQL = " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS column_name, min({c}) AS low, max({c}) AS high FROM lineitem GROUP BY l_returnflag"
    for c in ("l_quantity", "l_discount", "l-tax")
).replace("min(l-tax) AS low, max(l-tax)", "min(l_tax) AS low, max(l_tax)")


def _wide(spark, sf) -> DataFrame:
    """Bounds per flag, with a column name that needs quoting."""
    df = table(spark, sf, "lineitem").withColumnRenamed("l_tax", "l-tax")
    columns = ("l_quantity", "l_discount", "l-tax")
    return df.groupBy("l_returnflag").agg(
        *[f(F.col(f"`{c}`")).alias(f"{c}_{n}") for c in columns for n, f in (("low", F.min), ("high", F.max))]
    )


@query("h1_stack", _WIDE_SQL)
def stack(spark, sf):
    return reshape.stack_intervals(_wide(spark, sf), ["l_quantity", "l_discount", "l-tax"], ["l_returnflag"])


@query("h2_explode_structs", _WIDE_SQL)
def explode_structs(spark, sf):
    return reshape.explode_intervals(_wide(spark, sf), ["l_quantity", "l_discount", "l-tax"], ["l_returnflag"])
