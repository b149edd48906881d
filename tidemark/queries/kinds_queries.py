"""Column kinds and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import kinds as N
from tidemark.operators import quality as Q
from tidemark.operators.setops import union_all
from tidemark.queries.monitoring import R, flat, rounded
from tidemark.queries.registry import dealt, query, table
from tidemark.sources.tables import patterned_rows

_PROFILED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
}
# True kinds of the profiled columns, for the evaluations.
_NUMERIC = ["o_totalprice", "p_retailprice", "c_acctbal", "p_size"]


def profiles(spark, sf) -> DataFrame:
    parts = [N.column_profiles(table(spark, sf, t), cs) for t, cs in _PROFILED.items()]
    truth = F.when(F.col("column_name").isin(_NUMERIC), "numeric").otherwise("categorical")
    return union_all(parts).withColumn("truth", truth)


def _profile_sql() -> str:
    """Per column: counts, whether the five sampled values are numbers, any fraction."""
    cols = [(t, c) for t, cs in _PROFILED.items() for c in cs]
    text = {c: (f"{c}::VARCHAR") for _, c in cols}
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {text[c]} AS v, count(*) AS n FROM {t} GROUP BY ALL" for t, c in cols
    )
    return f"""vals AS ({rows}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY md5(v), v) AS rk FROM vals),
    prof AS (SELECT column_name, sum(n)::BIGINT AS total_vals, count(*) AS num_of_dist_val,
        count(*) FILTER (rk <= 5 AND try_cast(v AS DOUBLE) IS NULL) = 0 AS numbers,
        count(*) FILTER (rk <= 5 AND try_cast(v AS DOUBLE) <> floor(try_cast(v AS DOUBLE))) > 0 AS fraction,
        CASE WHEN column_name IN ('o_totalprice', 'p_retailprice', 'c_acctbal', 'p_size') THEN 'numeric' ELSE 'categorical' END AS truth
        FROM ranked GROUP BY column_name)"""


def _datetime_sql(source: str, names: list[str]) -> str:
    """The rule on distinct failing values, spelled out."""
    formats = """['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%S.%f',
        '%Y-%m-%dT%H:%M:%S%z', '%Y/%m/%d', '%m/%d/%Y', '%d %b %Y', '%b %d, %Y', '%d %B %Y']"""
    long = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v FROM src" for c in names)
    return f"""WITH src AS ({source}), long_ AS ({long}),
    t AS (SELECT *, coalesce(try_strptime(v, {formats}) IS NOT NULL, false) AS ok FROM long_)
    SELECT column_name, count(*) FILTER (ok) > 0 AND
        count(DISTINCT v) FILTER (NOT ok) + (count(*) > count(v))::INT <= 1 AS is_datetime FROM t GROUP BY column_name"""


@query(
    "n1_datetime_columns",
    _datetime_sql(
        """SELECT strftime(o_orderdate, '%Y-%m-%d') AS as_date, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS as_time,
        CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS one_bad,
        CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS nulls_only_bad,
        CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS two_bad,
        strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.250') AS fraction, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+02:00') AS moved,
        strftime(o_orderdate, '%d %b %Y') AS month_name,
        o_orderstatus AS status, o_orderpriority AS priority FROM orders""",
        ["as_date", "as_time", "one_bad", "nulls_only_bad", "two_bad", "fraction", "moved", "month_name", "status", "priority"],
    ),
)
def datetime_columns(spark, sf):
    """Order dates as text in several layouts, with failing values mixed in."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    third, fifth = F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5 == 0
    df = table(spark, sf, "orders").select(
        day.alias("as_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("as_time"),
        F.when(third, "unknown").otherwise(day).alias("one_bad"),
        F.when(~third, day).alias("nulls_only_bad"),
        F.when(third, "unknown").when(~fifth, day).alias("two_bad"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'.250'").alias("fraction"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("moved"),
        F.date_format("o_orderdate", "dd MMM yyyy").alias("month_name"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    return N.datetime_columns(df)


_PATTERNED = """SELECT strftime(DATE '2020-01-10' + (o_orderkey % 10)::INT, '%Y-%m-%d') AS day_text,
    strftime(TIMESTAMP '2020-01-10 00:00:00' + to_seconds(o_orderkey % 10), '%Y-%m-%d %H:%M:%S') AS moment_text,
    CASE WHEN o_orderkey % 10 <> 0 THEN strftime(DATE '2020-01-10' + (o_orderkey % 10)::INT, '%Y-%m-%d') END AS gappy_day,
    'label ' || o_orderkey % 10000 AS label FROM orders"""


@query("a8_patterned_rows", _PATTERNED)
def patterned(spark, sf):
    return patterned_rows(spark, table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))


@query(
    "n1_datetime_of_patterned_rows",
    _datetime_sql(_PATTERNED, ["day_text", "moment_text", "gappy_day", "label"]),
)
def datetime_of_patterned_rows(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return N.datetime_columns(patterned_rows(spark, ids))


@query(
    "n2_numeric_or_categorical",
    f"""WITH {_profile_sql()} SELECT column_name, total_vals, num_of_dist_val,
        CASE WHEN NOT numbers OR num_of_dist_val < 40 THEN 'categorical' ELSE 'numeric' END AS kind FROM prof""",
)
def numeric_or_categorical(spark, sf):
    return N.numeric_kind(profiles(spark, sf)).drop("samples", "truth")


@query(
    "n3_strength",
    f"""WITH {_profile_sql()} SELECT column_name,
        CASE WHEN numbers AND num_of_dist_val >= 40 AND (fraction OR num_of_dist_val >= 250) THEN 'strong_numeric'
            WHEN NOT numbers OR num_of_dist_val <= 10 THEN 'strong_categorical'
            WHEN num_of_dist_val >= 40 THEN 'weak_numeric' ELSE 'weak_categorical' END AS kind FROM prof""",
)
def strength(spark, sf):
    return N.numeric_strength(profiles(spark, sf)).select("column_name", "kind")


_FOLDED = "' ' || trim(regexp_replace(regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x7F]+', '~', 'g'), '[^a-z~]+', ' ', 'g')) || ' '"
_PAIRS = f"""(SELECT list_transform(range(1, len(c)), lambda i: {len(N.SYMBOLS)} * c[i] + c[i + 1])
    FROM (SELECT list_transform(string_split({_FOLDED}, ''), lambda x: strpos('{N.SYMBOLS}', x) - 1) AS c))"""
# Counts of symbol pairs in English and other documents, then the sum over every text's pairs.
_SCORES = f"""fitted AS (SELECT y, pair, count(*) AS n FROM (SELECT lang = 'en' AS y, unnest({_PAIRS.format(text='text')}) AS pair
    FROM documents WHERE lang IS NOT NULL) GROUP BY ALL),
ratios AS (SELECT pair, round(ln((coalesce(any_value(n) FILTER (y), 0) + 1) / (coalesce((SELECT sum(n) FROM fitted WHERE y), 0) + {len(N.SYMBOLS) ** 2}))
    - ln((coalesce(any_value(n) FILTER (NOT y), 0) + 1) / (coalesce((SELECT sum(n) FROM fitted WHERE NOT y), 0) + {len(N.SYMBOLS) ** 2})), 6) AS ratio
    FROM (SELECT * FROM fitted UNION ALL SELECT NULL, unnest(range({len(N.SYMBOLS) ** 2})), 0) GROUP BY pair),
texts AS (SELECT row_number() OVER () AS i, {{keys}}, {{text}} AS txt FROM {{table}}),
sums AS (SELECT i, sum(ratio) AS total, count(*) AS pairs
    FROM (SELECT i, unnest({_PAIRS.format(text='txt')}) AS pair FROM texts) JOIN ratios USING (pair) GROUP BY i),
sure AS (SELECT *, 1 / (1 + exp(-{N.STEEPNESS} * coalesce(total / nullif(pairs, 0), 0))) AS p FROM texts LEFT JOIN sums USING (i) WHERE txt IS NOT NULL),
scores AS (SELECT {{keys}}, count(*) AS n_rows, count(DISTINCT txt) / count(*) AS percent_distinct, avg(p) AS by_rows,
    avg((p > 0.5)::INT) AS by_share, 1 / (1 + exp(-{N.STEEPNESS} * sum(total) / sum(pairs))) AS by_concat FROM sure GROUP BY ALL)"""


def _scores_sql(keys: str, text: str, source: str) -> str:
    return _SCORES.replace("{keys}", keys).replace("{text}", text).replace("{table}", source)


def english_model(spark, sf) -> N.LanguageModel:
    docs = dealt(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")
    return N.fit_language(docs, "text", F.col("lang") == "en")


@query(
    "n5_english_confidence",
    f"""WITH {_scores_sql('lang', 'text', 'documents')} SELECT lang, n_rows, {R('percent_distinct')} AS percent_distinct,
        {R('by_rows')} AS by_rows, {R('by_share')} AS by_share, {R('by_concat')} AS by_concat FROM scores""",
)
def english_confidence(spark, sf):
    """Confidence by character pairs, fitted from the documents' own labels."""
    docs = dealt(table(spark, sf, "documents"), "doc_id")
    out = N.english_scores(docs, "text", english_model(spark, sf), ["lang"])
    return flat(out, "lang", "n_rows", "percent_distinct", "by_rows", "by_share", "by_concat")


def text_columns(spark, sf) -> DataFrame:
    """Text columns with their truth: documents by language, and two that hold codes."""
    docs = dealt(table(spark, sf, "documents"), "doc_id").select(F.concat(F.lit("text "), "lang").alias("c"), F.col("text").alias("t"))
    seg = table(spark, sf, "customer").select(F.lit("segment").alias("c"), F.col("c_mktsegment").alias("t"))
    brand = table(spark, sf, "part").select(F.lit("brand").alias("c"), F.col("p_brand").alias("t"))
    scores = N.english_scores(docs.unionByName(seg).unionByName(brand), "t", english_model(spark, sf), ["c"])
    return scores.withColumn("truth", F.col("c") == "text en")


_TEXT_SOURCE = """(SELECT 'text ' || lang AS c, text AS t FROM documents UNION ALL
    SELECT 'segment', c_mktsegment FROM customer UNION ALL SELECT 'brand', p_brand FROM part)"""


@query(
    "n4_text_columns",
    f"""WITH {_scores_sql('c', 't', _TEXT_SOURCE)} SELECT c AS column_name, percent_distinct >= 0.5 AND by_rows >= 0.5 AS is_text FROM scores""",
)
def is_text(spark, sf):
    yes = N.is_text(F.col("percent_distinct"), F.col("by_rows"), F.lit(0.5), F.lit(0.5))
    return text_columns(spark, sf).select(F.col("c").alias("column_name"), yes.alias("is_text"))


_P_GRID = [0.3, 0.4, 0.5, 0.6, 0.7]
_C_GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


@query(
    "n6_text_threshold_grid",
    f"""WITH {_scores_sql('c', 't', _TEXT_SOURCE)},
    g AS (SELECT p, q, c = 'text en' AS y, percent_distinct >= p AND by_rows >= q AS yes FROM scores,
        (SELECT unnest({_P_GRID}::DOUBLE[]) AS p), (SELECT unnest({_C_GRID}::DOUBLE[]) AS q)),
    k AS (SELECT p, q, count(*) FILTER (y AND yes) AS tp, count(*) FILTER (NOT y AND yes) AS fp, count(*) FILTER (y AND NOT yes) AS fn FROM g GROUP BY p, q)
    SELECT p, q, {R('coalesce(tp / nullif(tp + fp, 0), 0)')} AS "precision", {R('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall,
        {R('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1 FROM k""",
)
def text_threshold_grid(spark, sf):
    grid = N.with_grid(text_columns(spark, sf), p=_P_GRID, q=_C_GRID)
    yes = N.is_text(F.col("percent_distinct"), F.col("by_rows"), F.col("p"), F.col("q"))
    return flat(
        Q.precision_recall_f1(grid.withColumn("yes", yes), "truth", "yes", ["p", "q"]),
        "p", "q", "precision", "recall", "f1",
    )


@query(
    "n6_cardinality_threshold_grid",
    f"""WITH {_profile_sql()}, g AS (SELECT *, CASE WHEN NOT numbers OR num_of_dist_val < t THEN 'categorical' ELSE 'numeric' END AS kind
        FROM prof, (SELECT unnest(range(10, 210, 10)) AS t))
    SELECT t, {R("avg((kind = truth)::INT) FILTER (truth = 'categorical')")} AS categorical_accuracy,
        {R("avg((kind = truth)::INT) FILTER (truth = 'numeric')")} AS numeric_accuracy FROM g GROUP BY t""",
)
def cardinality_threshold_grid(spark, sf):
    grid = N.with_grid(profiles(spark, sf), t=list(range(10, 210, 10)))
    wrong = ~N.all_numbers(F.col("samples")) | (F.col("num_of_dist_val") < F.col("t"))
    right = (F.when(wrong, "categorical").otherwise("numeric") == F.col("truth")).cast("int")
    return grid.groupBy("t").agg(
        *[rounded(F.avg(F.when(F.col("truth") == k, right))).alias(f"{k}_accuracy") for k in ("categorical", "numeric")]
    )


@query(
    "n6_strong_threshold_grid",
    f"""WITH {_profile_sql()}, g AS (SELECT *, numbers AND num_of_dist_val >= 40 AND (fraction OR num_of_dist_val >= t) AS strong_numeric,
        NOT numbers OR num_of_dist_val <= t // 25 AS strong_categorical FROM prof, (SELECT unnest(range(40, 1000, 10)) AS t))
    SELECT t, {R("avg(strong_numeric::INT) FILTER (truth = 'categorical')")} AS false_numeric,
        {R("avg(strong_categorical::INT) FILTER (truth = 'numeric')")} AS false_categorical FROM g GROUP BY t""",
)
def strong_threshold_grid(spark, sf):
    """False-positive rates of the strong tests; the second limit is a 25th of the first."""
    grid = N.with_grid(profiles(spark, sf), t=list(range(40, 1000, 10)))
    n, s, t = F.col("num_of_dist_val"), F.col("samples"), F.col("t")
    strong_n = N.is_strong_numeric(n, s, t).cast("int")
    strong_c = N.is_strong_categorical(n, s, F.floor(t / 25)).cast("int")
    return grid.groupBy("t").agg(
        rounded(F.avg(F.when(F.col("truth") == "categorical", strong_n))).alias("false_numeric"),
        rounded(F.avg(F.when(F.col("truth") == "numeric", strong_c))).alias("false_categorical"),
    )


@query(
    "n7_sizes",
    f"""SELECT c AS dataset, count(t) AS size FROM {_TEXT_SOURCE} GROUP BY c""",
)
def sizes(spark, sf):
    return text_columns(spark, sf).select(F.col("c").alias("dataset"), F.col("n_rows").alias("size")).orderBy("size", "dataset")


@query(
    "e11_auc_of_cardinality",
    f"""WITH {_profile_sql()}, s AS (SELECT 1.0 - 1.0 / num_of_dist_val AS score, count(*) FILTER (truth = 'numeric') AS p,
        count(*) FILTER (truth <> 'numeric') AS n FROM prof WHERE numbers GROUP BY 1),
    r AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp FROM s)
    SELECT {R('sum(n * (tp - p / 2)) / (sum(p) * sum(n))')} AS auc FROM r""",
)
def auc_of_cardinality(spark, sf):
    """How well one minus the inverse cardinality tells numbers from codes."""
    scored = profiles(spark, sf).where(N.all_numbers(F.col("samples"))).select(
        (1 - 1 / F.col("num_of_dist_val")).alias("score"), (F.col("truth") == "numeric").alias("y")
    )
    return flat(Q.roc_auc(scored, "score", "y"), "auc")
