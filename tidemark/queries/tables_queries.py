"""Sources and sinks, recoding, joins, upserts, scalar functions, user extensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as cols
from tidemark.functions import dates
from tidemark.functions.draws import uniform
from tidemark.functions.stats import t_quantile
from tidemark.functions.templates import render
from tidemark.operators import joins as J
from tidemark.operators import profile as P
from tidemark.operators.bootstrap import weighted_stat
from tidemark.queries.monitoring import R, chi2_tail_sql, flat, rounded, stamp
from tidemark.queries.registry import query, table
from tidemark.session import scratch_name, scratch_path
from tidemark.sources import tables as A
from tidemark.spec import MonitorSpec, TimeSeries

# 2.A ---------------------------------------------------------------------------


@query(
    "a1_parquet_scan",
    f"""SELECT 'api' AS via, o_orderstatus, count(*) AS n, {R('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY ALL
    UNION ALL SELECT 'sql', o_orderstatus, count(*), {R('sum(o_totalprice)', 2)} FROM orders GROUP BY ALL""",
)
def parquet_scan(spark, sf):
    path = f"{sf}/orders.parquet"
    api = A.read_parquet(spark, path).withColumn("via", F.lit("api"))
    sql = spark.sql(f"SELECT * FROM parquet.`{path}`").withColumn("via", F.lit("sql"))
    return api.union(sql).groupBy("via", "o_orderstatus").agg(
        F.count("*").alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total")
    )


@query("a2_delimited_text", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def delimited_text(spark, sf):
    """Customer written as comma text with a blank after each comma, read with given names."""
    path = scratch_path(spark, "csv")
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    customer.select(F.concat_ws(", ", *[F.col(c).cast("string") for c in customer.columns])).write.text(path)
    return A.read_delimited(spark, path, customer.schema, columns=["c_custkey", "c_mktsegment", "c_acctbal"])


@query("a2_tab_separated", "SELECT p_partkey, p_brand FROM part")
def tab_separated(spark, sf):
    path = scratch_path(spark, "tsv")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    part.write.option("sep", "\t").option("header", True).csv(path)
    return A.read_delimited(spark, path, part.schema, "\t", True, ["p_partkey", "p_brand"])


@query("a3_catalog_table", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def catalog_table(spark, sf):
    """A table stored in the catalog, read by its name."""
    name = A.save_table(table(spark, sf, "orders"), scratch_name("orders"), path=scratch_path(spark, "orders"))
    return spark.table(name).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "a4_write_modes",
    """SELECT 'appended' AS how, o_orderkey, o_totalprice, NULL::VARCHAR AS status FROM orders
    UNION ALL SELECT 'overwritten', o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT 'new schema', o_orderkey, NULL, o_orderstatus FROM orders
    UNION ALL SELECT 'merged schema', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END,
        CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END FROM orders""",
)
def write_modes(spark, sf):
    df = table(spark, sf, "orders")
    price, status = df.select("o_orderkey", "o_totalprice"), df.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    even, odd = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 2 == 1
    folders = {n: scratch_path(spark, "table") for n in ("appended", "overwritten", "new schema", "merged schema")}
    A.write_table(price.where(even), folders["appended"])
    A.write_table(price.where(odd), folders["appended"])
    A.write_table(price, folders["overwritten"])
    A.write_table(price.where(even), folders["overwritten"], "overwrite")
    A.write_table(price, folders["new schema"])
    A.write_table(status, folders["new schema"], "overwrite")
    A.write_table(price.where(even), folders["merged schema"])
    A.write_table(status.where(odd), folders["merged schema"])
    wide = T.StructType(price.schema.fields + status.schema.fields[1:])
    out = [
        A.conform(A.read_parquet(spark, path, merge_schema=True), wide).withColumn("how", F.lit(how))
        for how, path in folders.items()
    ]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    "a5_partitioned_table",
    "SELECT strftime(ts, '%Y-%m-%d') AS date, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def partitioned_table(spark, sf):
    """Create-as-select of every row into date partitions, then an aggregate over them."""
    dated = table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    name = A.save_table(dated, scratch_name("events"), partition_by=["date"], path=scratch_path(spark, "events"))
    daily = spark.table(name).groupBy("date", "event_type").agg(F.count("*").alias("n"))
    return daily.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "event_type", "n")


@query(
    "a6_views",
    f"""SELECT n_name, {R('sum(c_acctbal)', 2)} AS balance, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def views(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("watched_customer")
    table(spark, sf, "nation").createOrReplaceTempView("watched_nation")
    spark.sql(
        "SELECT n_name, c_acctbal FROM watched_customer JOIN watched_nation ON c_nationkey = n_nationkey"
    ).createOrReplaceTempView("customer_by_nation")
    return spark.table("customer_by_nation").groupBy("n_name").agg(
        rounded(F.sum("c_acctbal"), 2).alias("balance"), F.count("*").alias("n")
    )


@query("a7_table_copy", "SELECT * FROM supplier")
def table_copy(spark, sf):
    """A copy stays as it was when its source changes."""
    supplier = table(spark, sf, "supplier")
    source = A.SnapshotTable(spark, scratch_path(spark, "source"))
    source.replace(supplier)
    copy = source.copy_to(scratch_path(spark, "copy"))
    source.replace(J.delete_where(source.read(), "s_suppkey IS NOT NULL"))
    return copy.read().join(source.read(), "s_suppkey", "left_anti")


# 2.B ---------------------------------------------------------------------------


@query("b1_column_subset", "SELECT c_custkey, c_mktsegment FROM customer")
def column_subset(spark, sf):
    return table(spark, sf, "customer").drop("c_name", "c_acctbal").select("c_custkey", "c_mktsegment")


@query(
    "b2_constant_columns",
    "SELECT o_orderkey, '1' AS model_version, '2022-10-01 00:00:00' AS event_time FROM orders",
)
def constant_columns(spark, sf):
    out = table(spark, sf, "orders").select("o_orderkey")
    out = out.withColumn("model_version", F.lit("1")).withColumn("event_time", F.lit("2022-10-01").cast("timestamp"))
    return out.withColumn("event_time", stamp(F.col("event_time")))


@query(
    "b3_drift_injection",
    """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGHEST' ELSE o_orderpriority END AS priority,
        CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE o_orderstatus END AS status, 1.0::DOUBLE AS price, count(*) AS n
    FROM orders GROUP BY ALL""",
)
def drift_injection(spark, sf):
    df = table(spark, sf, "orders")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return df.groupBy(
        F.when(urgent, "HIGHEST").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "DONE").otherwise(F.col("o_orderstatus")).alias("status"),
        F.lit(1).cast("double").alias("price"),
    ).agg(F.count("*").alias("n"))


@query(
    "b4_fault_injection",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS dt, {R("sum(CASE WHEN ts >= DATE '2024-01-24' THEN 0 ELSE value END)", 4)} AS total,
        count(CASE WHEN ts < DATE '2024-01-24' THEN event_type END) AS typed FROM events GROUP BY 1""",
)
def fault_injection(spark, sf):
    """From a day on, one column is zero and another is missing."""
    late = F.col("dt") >= F.lit("2024-01-24").cast("date")
    df = table(spark, sf, "events").withColumn("dt", F.to_date("ts"))
    df = df.withColumn("value", F.when(late, 0.0).otherwise(F.col("value")))
    df = df.withColumn("event_type", F.when(~late, F.col("event_type")))
    return df.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt")).agg(
        rounded(F.sum("value"), 4).alias("total"), F.count("event_type").alias("typed")
    )


@query(
    "b5_label_recode",
    """SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS l_returnflag,
        count(*) AS n FROM lineitem GROUP BY 1""",
)
def label_recode(spark, sf):
    df = table(spark, sf, "lineitem").replace({"A": "accepted", "R": "returned"}, subset=["l_returnflag"])
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(
    "b6_predicate_filter",
    "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') <> 'MACHINERY' AND c_acctbal >= 1000",
)
def predicate_filter(spark, sf):
    """A predicate given as text; rows for which it is NULL are dropped."""
    text = "nullif(c_mktsegment, 'BUILDING') <> 'MACHINERY' AND c_acctbal >= 1000"
    return table(spark, sf, "customer").where(F.expr(text)).select("c_custkey")


@query(
    "b10_columns_by_type",
    """SELECT unnest(['c_custkey', 'c_nationkey', 'c_acctbal']) AS column_name, 'numeric' AS kind, n FROM (SELECT count(*) AS n FROM customer)
    UNION ALL SELECT unnest(['c_name', 'c_mktsegment']), 'string', n FROM (SELECT count(*) AS n FROM customer)""",
)
def columns_by_type(spark, sf):
    df = table(spark, sf, "customer")
    named = [(c, "numeric") for c in cols.numeric_columns(df)] + [(c, "string") for c in cols.string_columns(df)]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind")) for c, k in named])
    return df.agg(F.count("*").alias("n")).select(F.inline(cells), "n")


@query(
    "b11_metric_lookup",
    f"""SELECT strftime(date_trunc('year', l_shipdate), '%Y-%m-%d %H:%M:%S') AS window_start, 'l_quantity' AS column_name,
        count(*) AS "count", {R('avg(l_quantity)')} AS "avg" FROM lineitem GROUP BY ALL""",
)
def metric_lookup(spark, sf):
    """Unsliced rows of one column from a metric table, newest window first."""
    spec = MonitorSpec(TimeSeries("l_shipdate"), ("1 month", "1 year"), ("l_returnflag",), columns=("l_quantity", "l_tax"), exact=False)
    P.profile(table(spark, sf, "lineitem"), spec).createOrReplaceTempView("analysis_metrics")
    rows = spark.sql(
        """SELECT window, column_name, count, avg FROM analysis_metrics
        WHERE log_type = 'INPUT' AND slice_key IS NULL AND column_name = 'l_quantity' AND granularity = '1 year'
        ORDER BY window.start DESC"""
    )
    return flat(rows, "window", "column_name", "count", "avg")


# 2.C ---------------------------------------------------------------------------


@query(
    "c5_late_labels",
    "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)",
)
def late_labels(spark, sf):
    """Labels joined by id; the table is replaced by the joined rows."""
    log = A.SnapshotTable(spark, scratch_path(spark, "log"))
    log.replace(table(spark, sf, "documents").select("doc_id", "lang"))
    log.replace(log.read().join(table(spark, sf, "labels").select("doc_id", "quality"), on="doc_id", how="left"))
    return log.read()


@query(
    "c6_join_chain",
    f"""WITH e AS (SELECT user_id AS c_custkey, count(*) AS n_events, {R('sum(value)', 4)} AS value FROM events GROUP BY 1)
    SELECT c_custkey, n_events, value, n_name, r_name FROM customer LEFT JOIN e USING (c_custkey)
        LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
)
def join_chain(spark, sf):
    """Three left joins in order; most customers have no event."""
    events = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count("*").alias("n_events"), rounded(F.sum("value"), 4).alias("value")
    )
    nations = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    regions = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    steps = [
        J.LeftJoin(events, ["n_events", "value"], ["c_custkey"]),
        J.LeftJoin(nations, ["n_name", "n_regionkey"], ["c_nationkey"]),
        J.LeftJoin(regions, ["r_name"], ["n_regionkey"]),
    ]
    chain = J.join_chain(table(spark, sf, "customer"), steps)
    return chain.select("c_custkey", "n_events", "value", "n_name", "r_name")


@query(
    "c7_upsert",
    """SELECT strftime(o_orderdate, '%Y-%m') AS date, o_orderkey, CASE WHEN year(o_orderdate) = 1996 THEN 'late' ELSE 'first' END AS source
    FROM orders UNION ALL SELECT '1996-07', -o_orderkey, 'late' FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-07'""",
)
def upsert(spark, sf):
    """A table of all orders, partitioned by month; one year replaces its rows and brings new ones."""
    path = scratch_path(spark, "orders")
    df = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("date"), "o_orderkey")
    keys = ["date", "o_orderkey"]
    year = df.where("date LIKE '1996%'")
    new = year.where("date = '1996-07'").withColumn("o_orderkey", -F.col("o_orderkey"))
    A.upsert_partitions(spark, path, df.withColumn("source", F.lit("first")), keys, "date")
    A.upsert_partitions(spark, path, year.union(new).withColumn("source", F.lit("late")), keys, "date")
    return spark.read.schema("o_orderkey long, source string, date string").parquet(path)


@query("c8_delete", "SELECT * FROM customer WHERE NOT coalesce(nullif(c_acctbal, 0) < 0, false)")
def delete(spark, sf):
    return J.delete_where(table(spark, sf, "customer"), "nullif(c_acctbal, 0) < 0")


@query("c9_insert_from_view", "SELECT c_custkey, c_mktsegment FROM customer")
def insert_from_view(spark, sf):
    """One insert for each segment of the view."""
    path = scratch_path(spark, "inserted")
    table(spark, sf, "customer").createOrReplaceTempView("watched_customer")
    segments = [r[0] for r in spark.sql("SELECT DISTINCT c_mktsegment FROM watched_customer").collect()]
    for segment in segments:
        rows = spark.sql("SELECT c_custkey, c_mktsegment FROM watched_customer WHERE c_mktsegment <=> :s", {"s": segment})
        A.write_table(rows, path)
    return A.read_parquet(spark, path)


@query(
    "c10_label_logging",
    """SELECT doc_id, coalesce(l.quality, 0) AS quality,
        (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE quality <> 0) AS updated
    FROM documents LEFT JOIN labels l USING (doc_id)""",
)
def label_logging(spark, sf):
    """Labels overwrite a default; every label comes twice, and once without a logged row."""
    log = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("quality"))
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    unknown = labels.select((-1 - F.col("doc_id")).alias("doc_id"), "quality")
    filled = J.log_labels(log, labels.unionByName(labels).unionByName(unknown), ["doc_id"], "quality")
    counted = J.updated_count(filled).select("updated").scalar()
    return filled.drop("_updated").withColumn("updated", counted)


# 2.J ---------------------------------------------------------------------------


@query("j1_epoch_millis", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def epoch_millis(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", stamp(F.timestamp_millis(ms)).alias("at"))


@query(
    "j2_saturday_week",
    """SELECT strftime(d - (dayofweek(d) + 1) % 7 * INTERVAL 1 DAY, '%Y-%m-%d') AS week_start, count(*) AS n
    FROM (SELECT o_orderdate::DATE AS d FROM orders) GROUP BY 1""",
)
def saturday_week(spark, sf):
    week = dates.saturday_week_start(F.to_date("o_orderdate"))
    return table(spark, sf, "orders").groupBy(F.date_format(week, "yyyy-MM-dd").alias("week_start")).agg(F.count("*").alias("n"))


@query(
    "j3_composite_id",
    """SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'run' || event_id END,
        user_id || '-' || nullif(event_type, 'click') || '-' || coalesce((CASE WHEN event_id % 2 = 0 THEN event_id % 7 END)::VARCHAR, '1')) AS workload_id
    FROM events""",
)
def composite_id(spark, sf):
    from tidemark.operators.usage import workload_id

    df = table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("workspace_id"),
        F.struct(
            F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("run"), F.col("event_id"))).alias("run_id"),
            F.nullif("event_type", F.lit("click")).alias("job_id"),
            F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 7).cast("string")).alias("id_in_job"),
        ).alias("tags"),
    )
    return df.select("event_id", workload_id().alias("workload_id"))


@query(
    "j4_math",
    f"""SELECT l_returnflag, {R('avg(ln(l_extendedprice))')} AS log_avg, {R('sum(sqrt(l_quantity) + l_tax ** 2)', 4)} AS total,
        sum(ceil(l_tax * 10) + floor(l_discount * 10) + abs(-l_linenumber))::BIGINT AS steps, {R('avg(exp(-l_tax))')} AS decay FROM lineitem GROUP BY ALL""",
)
def math_functions(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        rounded(F.avg(F.log("l_extendedprice"))).alias("log_avg"),
        rounded(F.sum(F.sqrt("l_quantity") + F.pow("l_tax", F.lit(2))), 4).alias("total"),
        F.sum(F.ceil(F.col("l_tax") * 10) + F.floor(F.col("l_discount") * 10) + F.abs(-F.col("l_linenumber"))).alias("steps"),
        rounded(F.avg(F.exp(-F.col("l_tax")))).alias("decay"),
    )


@query(
    "j5_arrays",
    """WITH f AS (SELECT l_orderkey, [l_quantity, l_quantity, l_tax, l_discount] AS a FROM lineitem)
    SELECT l_orderkey, list_sort(a)[2] AS second, list_contains(a, 0) AS has_zero, count(*) AS n FROM f GROUP BY ALL""",
)
def arrays(spark, sf):
    a = F.concat(F.array_repeat("l_quantity", 2), F.array("l_tax", "l_discount"))
    df = table(spark, sf, "lineitem").select("l_orderkey", a.alias("a"))
    return df.groupBy(
        "l_orderkey", F.element_at(F.array_sort("a"), 2).alias("second"), F.array_contains("a", 0.0).alias("has_zero")
    ).agg(F.count("*").alias("n"))


@query("j6_seeded_ids", "SELECT doc_id, md5('7-' || doc_id) AS example_id FROM documents")
def seeded_ids(spark, sf):
    seeded = F.md5(F.concat_ws("-", F.lit("7"), F.col("doc_id").cast("string")))
    return table(spark, sf, "documents").select("doc_id", seeded.alias("example_id"))


@query("j6_random_ids", "SELECT count(*) AS n, count(*) AS n_ids FROM documents")
def random_ids(spark, sf):
    """Random ids are all different; counted through a written copy, since they change
    with every run."""
    path = scratch_path(spark, "ids")
    table(spark, sf, "documents").select("doc_id", F.uuid().alias("id")).write.parquet(path)
    return spark.read.parquet(path).groupBy("id").agg(F.count("*").alias("k")).agg(
        F.sum("k").alias("n"), F.count("*").alias("n_ids")
    )


@query(
    "j7_random_columns",
    "SELECT (concat('0x', substr(md5(event_id || '-3'), 1, 8))::UBIGINT * 10 // 4294967296)::INT AS decile, count(*) AS n FROM events GROUP BY 1",
)
def random_columns(spark, sf):
    u = uniform(F.col("event_id"), 3)
    return table(spark, sf, "events").groupBy(F.floor(u * 10).cast("int").alias("decile")).agg(F.count("*").alias("n"))


@query(
    "j8_spread_dates",
    "SELECT strftime(DATE '2021-01-01' + (doc_id // 50)::INT, '%Y-%m-%d') AS dt, count(*) AS n FROM documents GROUP BY 1",
)
def spread_dates(spark, sf):
    day = dates.spread_dates(F.lit("2021-01-01").cast("date"), F.col("doc_id"), 50)
    return table(spark, sf, "documents").groupBy(F.date_format(day, "yyyy-MM-dd").alias("dt")).agg(F.count("*").alias("n"))


@query(
    "j9_dates",
    "SELECT strftime(ts::DATE + INTERVAL 3 DAY, '%Y-%m-%d') AS due, ts::DATE <= current_date AS past, count(*) AS n FROM events GROUP BY ALL",
)
def date_functions(spark, sf):
    day = F.to_date("ts")
    due = day + F.make_interval(days=F.lit(3))
    return table(spark, sf, "events").groupBy(
        F.date_format(due, "yyyy-MM-dd").alias("due"), (day <= F.current_date()).alias("past")
    ).agg(F.count("*").alias("n"))


# 2.M ---------------------------------------------------------------------------


@query(
    "m1_column_expressions",
    """SELECT dof, CASE WHEN dof < 10 THEN [12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157][dof]
        ELSE NULL END AS small, n FROM (SELECT (l_quantity)::INT AS dof, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def column_expressions(spark, sf):
    """A scalar function of the row as a column expression instead of a row UDF."""
    df = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("dof")).agg(F.count("*").alias("n"))
    return df.select("dof", F.when(F.col("dof") < 10, F.round(t_quantile(F.col("dof"), 0.95), 6)).alias("small"), "n")


@query(
    "m2_vectorised_function",
    f"""WITH c AS (SELECT month(l_shipdate) AS month, l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
    e AS (SELECT month, a, b, n, sum(n) OVER (PARTITION BY month, a) * sum(n) OVER (PARTITION BY month, b) / sum(n) OVER (PARTITION BY month) AS e FROM c),
    s AS (SELECT month, sum((n - e) ** 2 / e) AS chi, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM e GROUP BY month)
    SELECT month, {R('chi')} AS statistic, {R(chi2_tail_sql('chi', 'dof'))} AS p FROM s""",
)
def vectorised_function(spark, sf):
    """The one function the engine lacks, on one row per group: is the flag independent of the
    status, month by month?"""
    from tidemark.functions.stats import chi2_pvalue

    cells = table(spark, sf, "lineitem").groupBy(
        F.month("l_shipdate").alias("month"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")
    ).agg(F.count("*").cast("double").alias("n"))
    by = lambda *c: F.sum("n").over(Window.partitionBy("month", *c))
    expected = cells.withColumn("e", by("a") * by("b") / by())
    error = F.col("n") - F.col("e")
    rows = expected.groupBy("month").agg(
        F.sum(error * error / F.col("e")).alias("chi"),
        ((F.count_distinct("a") - 1) * (F.count_distinct("b") - 1)).alias("dof"),
    )
    p = chi2_pvalue(F.col("chi"), F.col("dof").cast("double"))
    return rows.select("month", rounded(F.col("chi")).alias("statistic"), rounded(p).alias("p"))


@query(
    "m3_grouped_aggregate",
    f"""SELECT event_type, {R('avg(value)')} AS "avg", {R('stddev_samp(value)')} AS stddev FROM events GROUP BY event_type""",
)
def grouped_aggregate(spark, sf):
    """Series-to-scalar functions as engine aggregates."""
    one = F.lit(1)
    return table(spark, sf, "events").groupBy("event_type").agg(
        rounded(weighted_stat("avg", F.col("value"), one)).alias("avg"),
        rounded(weighted_stat("stddev", F.col("value"), one)).alias("stddev"),
    )


@query(
    "m4_sql_text",
    f"""SELECT l_quantity > 25 AS slice, {R('max(l_quantity) - min(l_quantity)')} AS l_quantity, {R('max(l_tax) - min(l_tax)')} AS l_tax
    FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""",
)
def sql_text(spark, sf):
    """Filter, slice and metric are texts from the user."""
    template = "max(`{{column_name}}`) - min(`{{column_name}}`)"
    rows = table(spark, sf, "lineitem").where(F.expr("l_returnflag = 'R'"))
    return rows.groupBy(F.expr("l_quantity > 25").alias("slice")).agg(
        *[rounded(F.expr(render(template, column_name=c))).alias(c) for c in ("l_quantity", "l_tax")]
    )


