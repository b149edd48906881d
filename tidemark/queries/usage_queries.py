"""Usage roll-up over facts derived from the given tables (FIXTURES.md 1.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import saturday_week_start
from tidemark.operators import joins as J
from tidemark.operators import usage as U
from tidemark.queries.monitoring import R, rounded
from tidemark.queries.registry import query, table

SINCE = "2024-01-03"
ARGS = {"interactive": "click", "batch": "view", "package": "monitoring", "since": SINCE}


def workloads(spark, sf) -> DataFrame:
    """Events as workloads: the user is the workspace, the value its revenue."""
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.to_date("ts").alias("date"),
        F.when(F.col("user_id") % 3 == 0, "azure").when(F.col("user_id") % 3 == 1, "aws").alias("provider"),
        F.lit("external").alias("customer_type"),
        F.concat(F.lit("c"), F.col("user_id") % 10).alias("customer"),
        F.col("user_id").alias("workspace_id"),
        F.col("event_type").alias("workload_name"),
        F.struct(
            F.when(e % 2 == 0, "python").otherwise("sql").alias("language"),
            (e % 4).alias("num_python"),
        ).alias("tags"),
        F.when(e % 5 != 0, F.array(F.lit("base"), F.lit("monitoring"))).otherwise(F.array(F.lit("base"))).alias("packages"),
        F.col("value").alias("revenue"),
    )


def cluster_events(spark, sf) -> DataFrame:
    """Purchases mark a cluster as active on a day, many times over."""
    return table(spark, sf, "events").where("event_type = 'purchase'").select(
        F.to_date("ts").alias("date"), (F.col("user_id") % 50).alias("cluster_id")
    )


def clusters(spark, sf) -> DataFrame:
    """Cluster usage: units, sku and list price from the same event stream."""
    return table(spark, sf, "events").select(
        F.to_date("ts").alias("date"),
        F.when(F.col("user_id") % 3 == 0, "azure").when(F.col("user_id") % 3 == 1, "aws").alias("provider"),
        F.lit("external").alias("customer_type"),
        F.concat(F.lit("c"), F.col("user_id") % 10).alias("customer"),
        F.col("user_id").alias("workspace_id"),
        (F.col("user_id") % 50).alias("cluster_id"),
        F.when(F.col("event_id") % 2 == 0, "batch_managed").otherwise("batch").alias("sku"),
        F.col("value").alias("units"),
        (1 + F.col("user_id") % 4).cast("double").alias("list_price"),
    )


def rates(spark, sf) -> DataFrame:
    """Agreed rates of every fourth workspace and day; some are not filled in."""
    days = table(spark, sf, "events").select(F.to_date("ts").alias("date"), F.col("user_id").alias("workspace_id"))
    rate = F.when(F.col("workspace_id") % 8 != 0, 0.5 + (F.col("workspace_id") % 3))
    return days.where("workspace_id % 4 = 0").distinct().select(
        "date", "workspace_id", F.lit("batch_managed").alias("sku"), rate.alias("rate")
    )


_PROVIDER = "CASE user_id % 3 WHEN 0 THEN 'azure' WHEN 1 THEN 'aws' END"
_ACCOUNT = f"""ts::DATE AS date, {_PROVIDER} AS provider, 'external' AS customer_type, 'c' || user_id % 10 AS customer, user_id AS workspace_id"""
_PACKAGES = f"""SELECT {_ACCOUNT}, count(*) AS num_calls, sum(CASE WHEN event_type = 'click' THEN value * 1.2::DOUBLE ELSE value END) AS revenue
    FROM events WHERE ts >= DATE '{SINCE}' AND ((event_type = 'click' AND event_id % 2 = 0) OR (event_type = 'view' AND event_id % 4 > 0))
      AND event_id % 5 <> 0 GROUP BY ALL"""
_PRICE = f"""CASE WHEN user_id % 4 = 0 AND user_id % 8 <> 0 THEN 0.5::DOUBLE + user_id % 3
    WHEN ({_PROVIDER}) <> 'azure' THEN (1 + user_id % 4)::DOUBLE ELSE (1 + user_id % 4) * 0.85::DOUBLE END"""
_ACTIVE = "SELECT DISTINCT ts::DATE AS d, user_id % 50 AS k FROM events WHERE event_type = 'purchase'"
_CLUSTERS = f"""SELECT {_ACCOUNT}, sum(value * ({_PRICE})) AS revenue FROM events JOIN ({_ACTIVE}) ON d = ts::DATE AND k = user_id % 50
    WHERE event_id % 2 = 0 GROUP BY ALL"""
_KEYS = "strftime(date, '%Y-%m-%d') AS date, provider, customer_type, customer, workspace_id"


def _account(df: DataFrame, *measures) -> DataFrame:
    keys = [F.date_format("date", "yyyy-MM-dd").alias("date"), *U.ACCOUNT[1:]]
    return df.select(*keys, *measures)


@query("d22_package_revenue", f"SELECT {_KEYS}, num_calls, {R('revenue', 4)} AS revenue FROM ({_PACKAGES})")
def package_revenue(spark, sf):
    out = U.package_revenue(workloads(spark, sf), **ARGS)
    return _account(out, "num_calls", rounded(F.col("revenue"), 4).alias("revenue"))


@query("d23_cluster_revenue", f"SELECT {_KEYS}, {R('revenue', 4)} AS revenue FROM ({_CLUSTERS})")
def cluster_revenue(spark, sf):
    out = U.cluster_revenue(clusters(spark, sf), cluster_events(spark, sf), rates(spark, sf), "%managed%", "azure")
    return _account(out, rounded(F.col("revenue"), 4).alias("revenue"))


@query(
    "b8_fallback_price",
    f"SELECT DISTINCT user_id AS workspace_id, {R(_PRICE)} AS price FROM events",
)
def fallback_price(spark, sf):
    """Rate, else list price, discounted for one provider and for unknown ones."""
    pairs = clusters(spark, sf).select("workspace_id", "provider", "list_price").distinct()
    rate = rates(spark, sf).select("workspace_id", "rate").distinct()
    price = U.effective_price(F.col("rate"), F.col("list_price"), F.col("provider"), "azure")
    return pairs.join(rate, "workspace_id", "left").select("workspace_id", rounded(price).alias("price"))


@query(
    "b9_nested_predicates",
    f"""SELECT event_id % 4 AS num_python, event_type AS workload_name, count(*) AS n FROM events WHERE ts >= DATE '{SINCE}'
      AND ((event_type = 'click' AND event_id % 2 = 0) OR (event_type = 'view' AND event_id % 4 > 0))
      AND event_id % 5 <> 0 AND 'c' || user_id % 10 LIKE '%3%' GROUP BY ALL""",
)
def nested_predicates(spark, sf):
    t = F.col("tags")
    rows = workloads(spark, sf).where(
        (F.col("date") >= F.lit(SINCE).cast("date"))
        & (
            ((F.col("workload_name") == "click") & (t.getField("language") == "python"))
            | ((F.col("workload_name") == "view") & (t.getField("num_python") > 0))
        )
        & F.array_contains("packages", "monitoring")
        & F.col("customer").like("%3%")
    )
    return rows.groupBy(t.getField("num_python").alias("num_python"), "workload_name").agg(F.count("*").alias("n"))


@query(
    "c1_join_on_distinct_keys",
    f"SELECT user_id AS workspace_id, count(*) AS n FROM events JOIN ({_ACTIVE}) ON d = ts::DATE AND k = user_id % 50 GROUP BY 1",
)
def join_on_distinct_keys(spark, sf):
    active = J.keyed_semi_join(clusters(spark, sf), cluster_events(spark, sf), ["date", "cluster_id"])
    return active.groupBy("workspace_id").agg(F.count("*").alias("n"))


@query(
    "c2_left_join_rates",
    f"""SELECT user_id AS workspace_id, count(*) AS n, {R('sum(CASE WHEN user_id % 4 = 0 AND user_id % 8 <> 0 THEN 0.5::DOUBLE + user_id % 3 END)', 4)} AS rates
    FROM events WHERE event_id % 2 = 0 GROUP BY 1""",
)
def left_join_rates(spark, sf):
    """Counted per (day, workspace, sku) first, so a hot workspace joins as few rows."""
    keys = ["date", "workspace_id", "sku"]
    n = clusters(spark, sf).where("sku = 'batch_managed'").groupBy(*keys).agg(F.count("*").alias("k"))
    joined = n.join(rates(spark, sf), keys, "left")
    return joined.groupBy("workspace_id").agg(
        F.sum("k").alias("n"), rounded(F.sum(F.col("rate") * F.col("k")), 4).alias("rates")
    )


_FULL = f"""SELECT coalesce(p.date, c.date) AS date, coalesce(p.provider, c.provider) AS provider, coalesce(p.customer_type, c.customer_type) AS customer_type,
    coalesce(p.customer, c.customer) AS customer, coalesce(p.workspace_id, c.workspace_id) AS workspace_id, coalesce(num_calls, 0) AS num_calls,
    coalesce(p.revenue, 0) AS package_revenue, coalesce(c.revenue, 0) AS cluster_revenue
    FROM ({_PACKAGES}) p FULL JOIN ({_CLUSTERS}) c ON p.date = c.date AND p.workspace_id = c.workspace_id"""


@query(
    "c3_full_outer_join",
    f"SELECT {_KEYS}, num_calls, {R('package_revenue', 4)} AS package_revenue, {R('cluster_revenue', 4)} AS cluster_revenue FROM ({_FULL})",
)
def full_outer_join(spark, sf):
    out = U.combine_revenue(
        U.package_revenue(workloads(spark, sf), **ARGS),
        U.cluster_revenue(clusters(spark, sf), cluster_events(spark, sf), rates(spark, sf), "%managed%", "azure"),
    )
    return _account(
        out, "num_calls", *[rounded(F.col(c), 4).alias(c) for c in ("package_revenue", "cluster_revenue")]
    )


@query(
    "c4_dimension_join",
    "SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
)
def dimension_join(spark, sf):
    workspaces = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return table(spark, sf, "orders").join(workspaces, "o_custkey").groupBy("c_mktsegment", "o_orderstatus").agg(
        F.count("*").alias("n")
    )


@query(
    "d24_duplicate_removal",
    """SELECT 'group' AS how, strftime(ts, '%Y-%m-%d') AS date, user_id % 50 AS cluster_id FROM events WHERE event_type = 'purchase' GROUP BY ALL
    UNION ALL SELECT DISTINCT 'distinct', strftime(ts, '%Y-%m-%d'), user_id % 50 FROM events WHERE event_type = 'purchase'""",
)
def duplicate_removal(spark, sf):
    keys = cluster_events(spark, sf).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "cluster_id")
    grouped = keys.groupBy("date", "cluster_id").agg(F.first(F.lit("group")).alias("how"))
    return grouped.unionByName(keys.distinct().withColumn("how", F.lit("distinct")))


@query(
    "d26_usage_rollup",
    f"""SELECT {_KEYS}, strftime(date - (dayofweek(date) + 1) % 7 * INTERVAL 1 DAY, '%Y-%m-%d') AS week_start, num_calls,
        {R('package_revenue', 4)} AS package_revenue, {R('cluster_revenue', 4)} AS cluster_revenue,
        {R('package_revenue + cluster_revenue', 4)} AS revenue FROM ({_FULL})""",
)
def usage_rollup(spark, sf):
    out = U.usage_rollup(
        workloads(spark, sf), clusters(spark, sf), cluster_events(spark, sf), rates(spark, sf),
        sku_like="%managed%", reseller="azure", **ARGS,
    )
    return _account(
        out,
        F.date_format("week_start", "yyyy-MM-dd").alias("week_start"),
        "num_calls",
        *[rounded(F.col(c), 4).alias(c) for c in ("package_revenue", "cluster_revenue", "revenue")],
    )


@query(
    "c4_workspace_events",
    """SELECT c_name AS workspace_name, c_mktsegment, strftime(ts::DATE - (dayofweek(ts::DATE) + 1) % 7 * INTERVAL 1 DAY, '%Y-%m-%d') AS week_start,
        count(*) AS n FROM events JOIN customer ON c_custkey = user_id WHERE ts > DATE '2024-01-03' AND event_type = 'signup' GROUP BY ALL""",
)
def workspace_events(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("workspace_name"), "c_mktsegment")
    rows = table(spark, sf, "events").where((F.col("ts") > F.lit("2024-01-03").cast("timestamp_ntz")) & (F.col("event_type") == "signup"))
    week = F.date_format(saturday_week_start(F.to_date("ts")), "yyyy-MM-dd")
    return rows.join(names, "user_id").groupBy("workspace_name", "c_mktsegment", week.alias("week_start")).agg(F.count("*").alias("n"))
