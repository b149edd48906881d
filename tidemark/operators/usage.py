"""Daily usage and revenue roll-up.

Column names of the facts are those of FIXTURES.md section 1.7.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import saturday_week_start
from tidemark.operators.joins import keyed_semi_join

ACCOUNT = ["date", "provider", "customer_type", "customer", "workspace_id"]

# Surcharge on interactive runs and the reseller's discount.
INTERACTIVE_FACTOR = 1.2
RESELLER_DISCOUNT = 0.85


def effective_price(rate: Column, list_price: Column, provider: Column, reseller: str) -> Column:
    """The agreed rate, else the list price, discounted for one provider.

    An unknown provider is not known to differ from the reseller and gets the discount.
    """
    full = F.when(provider != reseller, list_price).otherwise(list_price * RESELLER_DISCOUNT)
    return F.when(rate.isNotNull(), rate).otherwise(full)


def package_revenue(workloads: DataFrame, package: str, since: str, interactive: str, batch: str) -> DataFrame:
    """Calls and revenue per day and account of workloads that use a package."""
    name = F.col("workload_name")
    relevant = (
        (F.col("date") >= F.lit(since).cast("date"))
        & (
            ((name == interactive) & (F.col("tags.language") == "python"))
            | ((name == batch) & (F.col("tags.num_python") > 0))
        )
        & F.array_contains("packages", package)
    )
    revenue = F.when(name == interactive, F.col("revenue") * INTERACTIVE_FACTOR).otherwise(
        F.col("revenue")
    )
    return workloads.where(relevant).groupBy(*ACCOUNT).agg(
        F.count("*").alias("num_calls"), F.sum(revenue).alias("revenue")
    )


def cluster_revenue(
    clusters: DataFrame, events: DataFrame, rates: DataFrame, sku_like: str, reseller: str
) -> DataFrame:
    """Revenue per day and account of clusters that logged an event.

    Units are added up per price-relevant key before the joins: a workspace or cluster
    with a third of all rows is reduced on the map side.
    """
    keys = [*ACCOUNT, "cluster_id", "sku", "list_price"]
    units = clusters.where(F.col("sku").like(sku_like)).groupBy(*keys).agg(F.sum("units").alias("units"))
    active = keyed_semi_join(units, events, ["date", "cluster_id"])
    by_price = active.groupBy(*ACCOUNT, "sku", "list_price").agg(F.sum("units").alias("units"))
    priced = by_price.join(rates.select("date", "workspace_id", "sku", "rate"), ["date", "workspace_id", "sku"], "left")
    price = effective_price(F.col("rate"), F.col("list_price"), F.col("provider"), reseller)
    return priced.groupBy(*ACCOUNT).agg(F.sum(F.col("units") * price).alias("revenue"))


def combine_revenue(packages: DataFrame, clusters: DataFrame) -> DataFrame:
    """Full join of both on day and workspace, missing sides as zero.

    The join uses two of the five grouping keys, so it may pair several rows; the result
    keeps them all.
    """
    p, c = packages.alias("p"), clusters.alias("c")
    joined = p.join(
        c,
        (F.col("p.date") == F.col("c.date")) & (F.col("p.workspace_id") == F.col("c.workspace_id")),
        "full_outer",
    )

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    out = joined.select(
        *[F.coalesce(f"p.{k}", f"c.{k}").alias(k) for k in ACCOUNT],
        zero("p.num_calls").alias("num_calls"),
        zero("p.revenue").alias("package_revenue"),
        zero("c.revenue").alias("cluster_revenue"),
        (zero("p.revenue") + zero("c.revenue")).alias("revenue"),
    )
    return out.withColumn("week_start", saturday_week_start(F.col("date")))


def usage_rollup(
    workloads: DataFrame,
    clusters: DataFrame,
    events: DataFrame,
    rates: DataFrame,
    package: str,
    since: str,
    interactive: str,
    batch: str,
    sku_like: str,
    reseller: str,
) -> DataFrame:
    return combine_revenue(
        package_revenue(workloads, package, since, interactive, batch),
        cluster_revenue(clusters, events, rates, sku_like, reseller),
    )


def workload_id() -> Column:
    """Run id, else workspace-job-run; NULL if workspace or job is NULL."""
    job = F.concat(
        F.col("workspace_id"), F.lit("-"), F.col("tags.job_id"), F.lit("-"),
        F.coalesce(F.col("tags.id_in_job"), F.lit("1")),
    )
    return F.coalesce(F.col("tags.run_id"), job)
