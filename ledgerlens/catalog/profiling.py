"""Profiling, outliers, missing values, encoding and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalog import sql as S
from ledgerlens.catalog.registry import query, single
from ledgerlens.functions.exprs import parsed_number, recoded, whole_days, yes_no_flag
from ledgerlens.operators import binning, clean, encode, missing, outliers, profile
from ledgerlens.session import reused
from ledgerlens.sources import views
from ledgerlens.sources.tables import parquet_table

COLUMNS = ("id", "mktsegment", "acctbal", "nationkey", "n_orders", "spend", "target")
NUMBERS = ("id", "acctbal", "nationkey", "n_orders", "spend", "target")
MEASURES = ("acctbal", "nationkey", "n_orders", "spend")


def profiled(spark, folder):
    """The customer profile, kept for the several passes of one report."""
    return reused(views.profile_table(spark, folder))


def rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _union(parts):
    return " UNION ALL ".join(parts)


def _metric(column, metric, expression, digits=4):
    return f"""SELECT '{column}' AS "column", '{metric}' AS metric, round(CAST({expression} AS DOUBLE), {digits}) AS value FROM prof"""


@query(
    "E1 A7 A8",
    f"WITH {S.PROFILE} "
    + _union(
        [_metric("*", "rows", "count(*)"), _metric("*", "columns", str(len(COLUMNS)) + " * (count(*) * 0 + 1)")]
        + [_metric(c, "nulls", f"count(*) - count({c})") for c in COLUMNS]
        + [_metric(c, f"q{p:g}", f"quantile_cont({c}, {p})") for c in NUMBERS for p in profile.PROFILE_QUANTILES]
    ),
)
def table_profile(spark, folder):
    return rounded(profile.table_profile(profiled(spark, folder)), "value")


_ENDS = "id, mktsegment, acctbal, nationkey, n_orders, spend, target"


@query(
    "E1 T2",
    f"WITH {S.PROFILE}, a AS (SELECT {_ENDS}, 'head' AS part FROM prof ORDER BY id LIMIT 5), b AS (SELECT {_ENDS}, 'tail' AS part FROM prof ORDER BY id DESC LIMIT 5) "
    "SELECT * FROM a UNION ALL SELECT * FROM b",
)
def table_ends(spark, folder):
    """Head and tail of the profile report, by key."""
    return profile.ends(views.profile_table(spark, folder), "id", 5)


_KINDS = {"id": "bigint", "mktsegment": "string", "acctbal": "double", "nationkey": "bigint", "n_orders": "bigint", "spend": "double", "target": "bigint"}


@query(
    "E1 A7",
    f"WITH {S.PROFILE} "
    + _union(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls, count({c}) AS present, '{k}' AS type FROM prof""" for c, k in _KINDS.items()),
)
def table_columns(spark, folder):
    """Type, nulls and present values of every column of the profile report."""
    return profile.null_counts(views.profile_table(spark, folder), with_type=True)


@query(
    "E2 A4",
    f"WITH {S.PROFILE} "
    + _union(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count,
        round(100.0 * count(*) / (SELECT count(*) FROM prof), 6) AS ratio FROM prof WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in ("mktsegment", "target", "nationkey")
    ),
)
def category_summary(spark, folder):
    return rounded(profile.category_summary(profiled(spark, folder), ["mktsegment", "target", "nationkey"]), "ratio", digits=6)


@query(
    "E3 A6",
    f"WITH {S.PROFILE} "
    + _union(
        [_metric(c, n, e) for c in MEASURES for n, e in (("count", f"count({c})"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})"), ("max", f"max({c})"))]
        + [_metric(c, f"{p * 100:g}%", f"quantile_cont({c}, {p})") for c in MEASURES for p in profile.SUMMARY_QUANTILES]
    ).replace("round(CAST(", "CAST(CAST((").replace(" AS DOUBLE), 4) AS value", ") AS FLOAT) AS DOUBLE) AS value"),
)
def numeric_summary(spark, folder):
    return profile.numeric_summary(profiled(spark, folder), MEASURES).withColumn("value", single(F.col("value")))


@query(
    "E4",
    f"WITH {S.PROFILE} "
    + _union(
        f"""SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c}) > 20 THEN 'high_cardinality' ELSE 'category' END AS kind FROM prof"""
        if c == "mktsegment"
        else f"""SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c}) < 10 THEN 'number_as_category' ELSE 'number' END AS kind FROM prof"""
        for c in COLUMNS
    ),
)
def column_kinds(spark, folder):
    df = profiled(spark, folder)
    groups = profile.column_groups(df)
    kinds = {c: "category" for c in groups.category}
    kinds.update({c: "number" for c in groups.number})
    kinds.update({c: "high_cardinality" for c in groups.high_cardinality})
    kinds.update({c: "number_as_category" for c in groups.number_as_category})
    return spark.createDataFrame(list(kinds.items()), "column string, kind string")


@query(
    "E5",
    f"WITH {S.PROFILE} "
    + _union(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, round(avg(target), 6) AS target_mean FROM prof WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in ("mktsegment", "nationkey")
    ),
)
def target_mean_by_category(spark, folder):
    return rounded(profile.target_by_category(views.profile_table(spark, folder), "target", ["mktsegment", "nationkey"]), "target_mean", digits=6)


@query(
    "E6",
    f"WITH {S.PROFILE} SELECT target, " + ", ".join(f"{S.single(f'avg({c})')} AS {c}" for c in MEASURES) + " FROM prof GROUP BY target",
)
def numeric_means_by_target(spark, folder):
    found = profile.numbers_by_target(views.profile_table(spark, folder), "target", MEASURES)
    return found.withColumns({c: single(F.col(c)) for c in MEASURES})


@query(
    "E7 X8",
    f"WITH {S.PROFILE} "
    + _union(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM prof"
        for i, a in enumerate(NUMBERS)
        for b in NUMBERS[i + 1 :]
    ),
)
def correlation_matrix(spark, folder):
    return rounded(profile.correlations(views.profile_table(spark, folder), NUMBERS), "corr", digits=6)


@query(
    "E8",
    """WITH t AS (SELECT l_quantity AS quantity, l_extendedprice AS extended, l_extendedprice * (1 - l_discount) AS net, l_discount AS discount FROM lineitem),
    c AS (SELECT 'extended' AS "column", corr(quantity, extended) AS r FROM t UNION ALL SELECT 'net', corr(quantity, net) FROM t
          UNION ALL SELECT 'net', corr(extended, net) FROM t UNION ALL SELECT 'discount', corr(quantity, discount) FROM t
          UNION ALL SELECT 'discount', corr(extended, discount) FROM t UNION ALL SELECT 'discount', corr(net, discount) FROM t)
    SELECT DISTINCT "column" FROM c WHERE abs(r) > 0.90""",
)
def highly_correlated_columns(spark, folder):
    lines = parquet_table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extended"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.col("l_discount").alias("discount"),
    )
    return profile.correlated_columns(lines, lines.columns)


@query(
    "E9",
    f"WITH {S.SERVICES} "
    + _union(
        f"""SELECT '{a} vs. {b}' AS pair,
        round(100.0 * count(*) FILTER (({a} = 'Yes' AND {b} = 'Yes') OR ({a} = 'No' AND {b} = 'No')) / count(*), 6) AS same,
        round(100.0 * count(*) FILTER ({a} <> {b}) / count(*), 6) AS different FROM services"""
        for a, b in (("backup", "support"), ("backup", "streaming"), ("support", "streaming"))
    ),
)
def service_agreement(spark, folder):
    found = profile.service_agreement(views.service_table(spark, folder), ["backup", "support", "streaming"])
    return rounded(found, "same", "different", digits=6)


@query(
    "E10",
    f"WITH {S.SERVICES} "
    + _union(
        f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS count FROM services WHERE plan = 'ECONOMY' GROUP BY {c}"""
        for c in ("backup", "support", "streaming")
    ),
)
def service_consistency(spark, folder):
    return profile.values_where(views.service_table(spark, folder), "plan", "ECONOMY", ["backup", "support", "streaming"])


@query(
    "E11",
    f"WITH {S.PROFILE} "
    + _union(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count,
        round(count(*) / (SELECT count(*) FROM prof), 8) AS ratio, round(avg(target), 6) AS target_mean FROM prof
        WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in ("mktsegment", "nationkey", "n_orders")
    ),
)
def rare_category_report(spark, folder):
    found = profile.rare_report(profiled(spark, folder), "target", ["mktsegment", "nationkey", "n_orders"])
    return rounded(rounded(found, "target_mean", digits=6), "ratio", digits=8)


@query(
    "E12",
    f"""WITH {S.SERVICES}, wide AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part),
    n AS (SELECT count(*) AS n FROM wide),
    rn AS (SELECT name FROM wide GROUP BY name HAVING count(*) / (SELECT n FROM n) < 0.015),
    rb AS (SELECT brand FROM wide GROUP BY brand HAVING count(*) / (SELECT n FROM n) < 0.04)
    SELECT CASE WHEN name IN (SELECT name FROM rn) THEN 'Rare' ELSE name END AS name,
           CASE WHEN brand IN (SELECT brand FROM rb) THEN 'Rare' ELSE brand END AS brand, count(*) AS parts FROM wide GROUP BY ALL""",
)
def rare_category_encoding(spark, folder):
    part = parquet_table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    coded = encode.rare_encoded(encode.rare_encoded(part, 0.015, ["name"]), 0.04, ["brand"])
    return coded.groupBy("name", "brand").agg(F.count(F.lit(1)).alias("parts"))


@query(
    "E13",
    """WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    b AS (SELECT CAST(least(19, floor((l_extendedprice - lo) * 20 / (hi - lo))) AS BIGINT) AS bin, lo, hi FROM lineitem, m)
    SELECT bin, round(lo + bin * ((hi - lo) / 20), 4) AS low, round(lo + (bin + 1) * ((hi - lo) / 20), 4) AS high, count(*) AS count
    FROM b GROUP BY bin, lo, hi""",
)
def price_histogram(spark, folder):
    lines = parquet_table(spark, folder, "lineitem").select("l_extendedprice")
    return rounded(profile.histogram(lines, "l_extendedprice"), "low", "high")


@query(
    "E13",
    f"WITH {S.PROFILE} "
    + _union(
        f"""SELECT '{c}' AS "column", {S.single(f"min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1))")} AS low, {S.single("any_value(q1)")} AS q1,
        {S.single("any_value(q2)")} AS median, {S.single("any_value(q3)")} AS q3,
        {S.single(f"max({c}) FILTER ({c} <= q3 + 1.5 * (q3 - q1))")} AS high,
        count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS beyond
        FROM prof, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM prof)"""
        for c in ("acctbal", "n_orders", "spend")
    ),
)
def box_plot_numbers(spark, folder):
    found = profile.box_plot(profiled(spark, folder), ["acctbal", "n_orders", "spend"])
    return found.withColumns({c: single(F.col(c)) for c in ("low", "q1", "median", "q3", "high")})


@query(
    "E13",
    _union(
        f"""SELECT '{y}' AS "column", {S.single(f"regr_slope({y}, l_extendedprice)")} AS slope, {S.single(f"regr_intercept({y}, l_extendedprice)")} AS intercept FROM lineitem"""
        for y in ("l_quantity", "l_discount", "l_tax")
    ),
)
def regression_lines(spark, folder):
    lines = parquet_table(spark, folder, "lineitem")
    found = profile.regression_line(lines, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return found.withColumns({c: single(F.col(c)) for c in ("slope", "intercept")})


@query("A2", "SELECT count(DISTINCT p_name) AS names, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types FROM part")
def distinct_value_counts(spark, folder):
    part = parquet_table(spark, folder, "part")
    return part.agg(F.count_distinct("p_name").alias("names"), F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"))


@query("A3", f"WITH {S.PROFILE} SELECT DISTINCT mktsegment FROM prof")
def distinct_segments(spark, folder):
    return views.profile_table(spark, folder).select("mktsegment").distinct()


@query("A4 A9", "SELECT p_name AS name, count(*) AS count FROM part GROUP BY p_name ORDER BY count DESC, name LIMIT 5")
def most_frequent_names(spark, folder):
    part = parquet_table(spark, folder, "part").select(F.col("p_name").alias("name"))
    return profile.frequency_table(part, "name").orderBy(F.desc("count"), "name").limit(5)


@query("A5", "SELECT p_type AS type, p_brand AS brand, count(*) AS count FROM part GROUP BY ALL")
def type_brand_frequencies(spark, folder):
    part = parquet_table(spark, folder, "part").select(F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))
    return profile.frequency_table(part, "type", "brand")


@query(
    "A9 A10",
    f"""SELECT user_id, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS active_days,
    CAST(floor((epoch_us(TIMESTAMP '2024-12-01 00:00:00') - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS age_days,
    max(value) AS top_value, min(value) AS low_value FROM events GROUP BY user_id""",
)
def event_spans(spark, folder):
    now = F.lit("2024-12-01 00:00:00").cast("timestamp")
    return parquet_table(spark, folder, "events").groupBy("user_id").agg(
        whole_days(F.max("ts"), F.min("ts")).alias("active_days"),
        whole_days(now, F.min("ts")).alias("age_days"),
        F.max("value").alias("top_value"),
        F.min("value").alias("low_value"),
    )


@query(
    "O3 O1",
    _union(
        f"""SELECT '{c}' AS "column", round(any_value(lo), 4) AS low, round(any_value(hi), 4) AS high, bool_or({c} < lo OR {c} > hi) AS has_outliers
        FROM events, (SELECT quantile_cont({c}, 0.05) - 1.5 * (quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05)) AS lo,
                             quantile_cont({c}, 0.95) + 1.5 * (quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05)) AS hi FROM events)"""
        for c in ("value", "user_id")
    ),
)
def outlier_check(spark, folder):
    events = parquet_table(spark, folder, "events")
    return rounded(outliers.outlier_check(events, ["value", "user_id"], outliers.WIDE_QUANTILES), "low", "high")


_EVENT_FENCE = """f AS (SELECT quantile_cont(value, {0}) - 1.5 * (quantile_cont(value, {1}) - quantile_cont(value, {0})) AS lo,
  quantile_cont(value, {1}) + 1.5 * (quantile_cont(value, {1}) - quantile_cont(value, {0})) AS hi FROM events)"""


@query("O4", f"WITH {_EVENT_FENCE.format(0.05, 0.95)} SELECT event_id, user_id, value FROM events, f WHERE value < lo OR value > hi")
def outlier_rows(spark, folder):
    events = parquet_table(spark, folder, "events").select("event_id", "user_id", "value")
    return outliers.outlier_rows(events, "value", outliers.WIDE_QUANTILES)


@query("O4", f"WITH {_EVENT_FENCE.format(0.05, 0.95)} SELECT event_id FROM events, f WHERE value < lo OR value > hi")
def outlier_keys(spark, folder):
    return outliers.outlier_keys(parquet_table(spark, folder, "events"), "value", "event_id", outliers.WIDE_QUANTILES)


@query(
    "O5",
    f"""WITH {_EVENT_FENCE.format(0.005, 0.995)} SELECT event_type, count(*) AS n, max(value) AS top FROM events, f
    WHERE NOT (value < lo OR value > hi) GROUP BY event_type""",
)
def outliers_removed(spark, folder):
    kept = outliers.remove_outliers(parquet_table(spark, folder, "events"), "value")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@query(
    "M1 A7 F7",
    f"WITH {S.PROFILE}, c AS ("
    + _union(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_miss, count(*) AS n FROM prof""" for c in COLUMNS)
    + """) SELECT "column", n_miss, round_even(n_miss * 100.0 / n, 2) AS ratio FROM c WHERE n_miss > 0""",
)
def missing_values(spark, folder):
    return missing.missing_report(views.profile_table(spark, folder))


@query(
    "M2 P10",
    f"WITH {S.PROFILE} "
    + _union(
        f"""SELECT '{c}' AS "column", CAST({c} IS NULL AS INT) AS missing, round(avg(target), 6) AS target_mean, count(target) AS count
        FROM prof GROUP BY {c} IS NULL"""
        for c in ("mktsegment", "acctbal")
    ),
)
def missing_against_target(spark, folder):
    found = missing.missing_against_target(views.profile_table(spark, folder), "target", ["mktsegment", "acctbal"])
    return rounded(found, "target_mean", digits=6)


@query(
    "P13 P14",
    _union(f"""SELECT '{c}' AS "column", bool_or({c} = 0) AS has_zero, count(*) FILTER ({c} = 0 OR {c} IS NULL) AS converted FROM lineitem""" for c in ("l_discount", "l_tax", "l_quantity")),
)
def zero_as_missing(spark, folder):
    return clean.zero_report(parquet_table(spark, folder, "lineitem"), ["l_discount", "l_tax", "l_quantity"])


@query(
    "P13",
    "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, nullif(l_quantity, 0) AS l_quantity FROM lineitem",
)
def zeros_converted(spark, folder):
    """The rows with zeros taken as missing."""
    lines = parquet_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    return clean.zeros_to_null(lines, ["l_discount", "l_tax", "l_quantity"])


@query(
    "X7",
    """SELECT p_partkey AS id, """
    + ", ".join(f"""CAST(p_type = '{t}' AS INT) AS "type_{t}\"""" for t in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + " FROM part",
)
def one_hot_types(spark, folder):
    part = parquet_table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"))
    return encode.one_hot(part)


@query(
    "L1",
    """SELECT p_partkey AS id, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INT) AS type,
    CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INT) AS brand FROM part""",
)
def label_encoding(spark, folder):
    part = parquet_table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand")
    )
    return encode.label_encoded(part, ["type", "brand"])


def _robust(c):
    return f"({c} - (SELECT quantile_cont({c}, 0.5) FROM prof)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM prof)"


@query("L2", f"WITH {S.PROFILE} SELECT id, " + ", ".join(f"round({_robust(c)}, 6) AS {c}" for c in MEASURES) + " FROM prof")
def robust_scaling(spark, folder):
    scaled = encode.robust_scaled(profiled(spark, folder), MEASURES)
    return rounded(scaled.select("id", *MEASURES), *MEASURES, digits=6)


@query(
    "L3",
    f"WITH {S.PROFILE} SELECT id, "
    + ", ".join(f"round(({c} - (SELECT min({c}) FROM prof)) / (SELECT CAST(max({c}) - min({c}) AS DOUBLE) FROM prof), 6) AS {c}, round(CAST({c} AS DOUBLE), 4) AS {c}_back" for c in MEASURES)
    + " FROM prof",
)
def min_max_scaling(spark, folder):
    df = profiled(spark, folder).select("id", *MEASURES)
    limits = encode.min_max_parameters(df, MEASURES)
    scaled = encode.min_max_scaled(df, limits).withColumns({f"{c}_back": F.col(c) for c in MEASURES})
    back = encode.min_max_restored(scaled, {f"{c}_back": v for c, v in limits.items()})
    return rounded(rounded(back, *MEASURES, digits=6), *[f"{c}_back" for c in MEASURES])


@query(
    "L4",
    f"WITH {S.PROFILE} SELECT id, "
    + ", ".join(f"round(({c} - (SELECT avg({c}) FROM prof)) / (SELECT stddev_pop({c}) FROM prof), 6) AS {c}" for c in MEASURES)
    + " FROM prof",
)
def standard_scaling(spark, folder):
    scaled = encode.standard_scaled(profiled(spark, folder).select("id", *MEASURES), MEASURES)
    return rounded(scaled, *MEASURES, digits=6)


AGE_EDGES = (20, 35, 50, 65, 100)
AGE_LABELS = ("Young", "Early", "Late", "Old")


@query(
    "W4 P10 P11 L5",
    f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 101 <= 20 THEN NULL WHEN c_custkey % 101 <= 35 THEN 'Young'
      WHEN c_custkey % 101 <= 50 THEN 'Early' WHEN c_custkey % 101 <= 65 THEN 'Late' ELSE 'Old' END AS age_group,
    CAST(c_acctbal > 0 AS INT) AS in_credit,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'HOUSEHOLD' THEN 2 END AS segment_code,
    round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer) * 0.6
      + CAST(c_nationkey AS DOUBLE) / (SELECT max(c_nationkey) - min(c_nationkey) FROM customer) * 0.4
      - (SELECT CAST(min(c_nationkey) AS DOUBLE) / (max(c_nationkey) - min(c_nationkey)) FROM customer) * 0.4, 6) AS combined
    FROM customer""",
)
def derived_features(spark, folder):
    customer = parquet_table(spark, folder, "customer")
    limits = encode.min_max_parameters(customer, ["c_acctbal", "c_nationkey"])
    scaled = encode.min_max_scaled(customer.select("*", F.col("c_acctbal").alias("balance")), limits)
    return scaled.select(
        F.col("c_custkey").alias("id"),
        binning.fixed_bins(F.col("c_custkey") % 101, AGE_EDGES, AGE_LABELS).alias("age_group"),
        yes_no_flag(F.col("balance") > 0).alias("in_credit"),
        recoded(F.col("c_mktsegment"), {"AUTOMOBILE": 0, "BUILDING": 1, "HOUSEHOLD": 2}).alias("segment_code"),
        F.round(F.col("c_acctbal") * 0.6 + F.col("c_nationkey") * 0.4, 6).alias("combined"),
    )


@query(
    "P9 P12",
    """SELECT event_id, coalesce(TRY_CAST(trim(regexp_extract(props, '"k": ([0-9]*)', 1)) AS DOUBLE), -1) AS k FROM events""",
)
def parsed_properties(spark, folder):
    events = parquet_table(spark, folder, "events")
    return events.select("event_id", F.coalesce(parsed_number(F.get_json_object("props", "$.k")), F.lit(-1.0)).alias("k"))


@query(
    "P5 P6",
    """SELECT p_type AS type, count(*) AS parts FROM part WHERE p_type IN ('PROMO', 'LARGE') AND p_brand IN ('Brand#2', 'Brand#17')
    AND NOT (p_size < 5 AND p_retailprice > 1500) AND p_size <> 0 GROUP BY p_type""",
)
def filtered_parts(spark, folder):
    part = parquet_table(spark, folder, "part").filter(F.col("p_type").isin("PROMO", "LARGE") & F.col("p_brand").isin("Brand#2", "Brand#17"))
    kept = clean.drop_matching(part, F.col("p_size") == 0, (F.col("p_size") < 5) & (F.col("p_retailprice") > 1500))
    return kept.groupBy(F.col("p_type").alias("type")).agg(F.count(F.lit(1)).alias("parts"))


@query(
    "P15",
    "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
)
def last_event_per_user(spark, folder):
    return clean.keep_last(parquet_table(spark, folder, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("P16 P7", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def repeated_columns_dropped(spark, folder):
    wanted = ["o_orderkey", "o_custkey", "o_orderkey", "o_totalprice", "o_custkey"]
    return parquet_table(spark, folder, "orders").select(*clean.distinct_columns(wanted))


@query("X6", """SELECT 'c_name' AS "column", c_name AS value FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer WHERE c_custkey = 1
    UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey = 1""")
def customer_card(spark, folder):
    row = parquet_table(spark, folder, "customer").filter(F.col("c_custkey") == 1)
    return profile.transposed(row, ["c_name", "c_mktsegment", "c_nationkey"])
