"""Probabilistic lifetime value, and what is built on lifetime values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalog import sql as S
from ledgerlens.catalog.registry import query, single
from ledgerlens.catalog.segments import segmented, today
from ledgerlens.operators.order_stats import top_share
from ledgerlens.operators.profile import frequency_table
from ledgerlens.plans import cltv, probabilistic
from ledgerlens.plans.rfm import clean_lines
from ledgerlens.session import reused
from ledgerlens.sources import views
from ledgerlens.sources.views import TODAY

_FEATURES = f"""features AS (
  SELECT customer_id, floor((epoch(max(invoice_date)) - epoch(min(invoice_date))) / 86400) / 7 AS recency,
         floor((epoch(TIMESTAMP '{TODAY}') - epoch(min(invoice_date))) / 86400) / 7 AS age,
         count(DISTINCT invoice) AS frequency, sum(quantity * price) / count(DISTINCT invoice) AS monetary
  FROM clipped GROUP BY customer_id HAVING count(DISTINCT invoice) > 1)"""

# Parameters for the check of the closed-form profit forecast.
PROFIT = probabilistic.ProfitModel(p=2.0, q=0.9, v=3.75)


def _lines(spark, folder):
    return clean_lines(views.retail_lines(spark, folder, sold_only=True), clip_outliers=True)


@query(
    "C6 A10 F6",
    f"WITH {S.CLIPPED}, {_FEATURES} SELECT customer_id, round(recency, 6) AS recency, round(age, 6) AS age, frequency, {S.single('monetary')} AS monetary FROM features",
)
def lifetime_features(spark, folder):
    found = probabilistic.lifetime_features(_lines(spark, folder), today())
    return found.select(
        "customer_id", F.round("recency", 6).alias("recency"), F.round("age", 6).alias("age"), "frequency", single(F.col("monetary")).alias("monetary")
    )


@query(
    "C9",
    f"""WITH {S.CLIPPED}, {_FEATURES} SELECT customer_id,
    {S.single(f'{PROFIT.p} * ({PROFIT.v} + frequency * monetary) / ({PROFIT.p} * frequency + {PROFIT.q} - 1)')} AS expected_profit FROM features""",
)
def expected_profit_by_model(spark, folder):
    found = probabilistic.lifetime_features(_lines(spark, folder), today())
    profit = probabilistic.expected_profit(PROFIT, F.col("frequency"), F.col("monetary"))
    return found.select("customer_id", single(profit).alias("expected_profit"))


@query("C7 C8 C9 C10 C12 C13 U5")
def probabilistic_lifetime_value(spark, folder):
    return probabilistic.lifetime_table(_lines(spark, folder), today(), months=3)


def _horizons(spark, folder):
    features = reused(probabilistic.lifetime_features(_lines(spark, folder), today()))
    models = probabilistic.fit_purchases(features), probabilistic.fit_profit(features)
    valued = reused(probabilistic.with_lifetime_value(features, *models, [1, 6, 12]))
    return probabilistic.scaled_lifetime_value(valued, [1, 6, 12])


@query("C10 C11")
def lifetime_value_horizons(spark, folder):
    return _horizons(spark, folder)


@query("C15 T2")
def lifetime_value_leaders(spark, folder):
    return probabilistic.same_leaders(_horizons(spark, folder), "scaled_clv_1m", "scaled_clv_12m")


#: Parameters at which forecasts are compared with SQL: fixed values, those published for the CDNOW sample and for its spending.
PURCHASES = probabilistic.PurchaseModel(r=0.243, alpha=4.414, a=0.793, b=2.426)
SPENDING = probabilistic.ProfitModel(p=6.25, q=3.74, v=15.44)
_TERMS = 600


def _series_sql(t: str) -> str:
    """Expected purchases within ``t`` weeks, by the sum that defines the hypergeometric function, term by term through log-gamma."""
    r, alpha, a, b = PURCHASES.r, PURCHASES.alpha, PURCHASES.a, PURCHASES.b
    x = "frequency"
    term = f"""exp(lgamma({r} + {x} + k) - lgamma({r} + {x}) + lgamma({b} + {x} + k) - lgamma({b} + {x}) - lgamma({a + b - 1} + {x} + k) + lgamma({a + b - 1} + {x})
               - lgamma(k + 1.0) + k * ln({t} / ({alpha} + age + {t})))"""
    series = f"list_sum(list_transform(range({_TERMS}), lambda k: {term}))"
    shrink = f"pow(({alpha} + age) / ({alpha} + age + {t}), {r} + {x})"
    alive = f"(1 + {a} / ({b} + {x} - 1) * pow(({alpha} + age) / ({alpha} + recency), {r} + {x}))"
    return f"(({a + b - 1} + {x}) / ({a - 1}) * (1 - {shrink} * {series}) / {alive})"


_MARGIN = f"({SPENDING.p} * ({SPENDING.v} + frequency * monetary) / ({SPENDING.p} * frequency + {SPENDING.q} - 1))"
_FORECAST = f"""monthly AS (
  SELECT customer_id, frequency, monetary, month, {_series_sql(f'({probabilistic.WEEKS_PER_MONTH} * month)')} AS upto FROM features, (SELECT unnest(range(1, 13)) AS month)),
steps AS (SELECT *, (upto - coalesce(lag(upto) OVER (PARTITION BY customer_id ORDER BY month), 0)) / pow(1.01, month) * {_MARGIN} AS gain FROM monthly),
valued AS (SELECT customer_id, sum(gain) FILTER (month <= 1) AS clv_1m, sum(gain) FILTER (month <= 6) AS clv_6m, sum(gain) AS clv_12m FROM steps GROUP BY customer_id),
scaled AS (SELECT *, (clv_1m - min(clv_1m) OVER ()) / (max(clv_1m) OVER () - min(clv_1m) OVER ()) AS scaled_1m,
                  (clv_12m - min(clv_12m) OVER ()) / (max(clv_12m) OVER () - min(clv_12m) OVER ()) AS scaled_12m FROM valued)"""


def _at_fixed_parameters(spark, folder):
    features = reused(probabilistic.lifetime_features(_lines(spark, folder), today()))
    valued = reused(probabilistic.with_lifetime_value(features, PURCHASES, SPENDING, [1, 6, 12]))
    return probabilistic.scaled_lifetime_value(valued, [1, 6, 12])


@query(
    "C8 U5",
    f"""WITH {S.CLIPPED}, {_FEATURES} SELECT customer_id, {', '.join(f"round({_series_sql(f'{t}.0')}, 8) AS purchases_{t}w" for t in (1, 4, 12))} FROM features""",
)
def purchase_forecasts(spark, folder):
    """Expected purchases of each customer at fixed parameters, against the defining series."""
    features = reused(probabilistic.lifetime_features(_lines(spark, folder), today()))
    seen = [F.col(c) for c in ("frequency", "recency", "age")]
    return features.select("customer_id", *[F.round(probabilistic.expected_purchases(PURCHASES, t, *seen), 8).alias(f"purchases_{t}w") for t in (1, 4, 12)])


@query(
    "C10 C11 C13",
    f"""WITH {S.CLIPPED}, {_FEATURES}, {_FORECAST}
    SELECT customer_id, {', '.join(f'round({c} / 1000, 4) AS {c}' for c in ('clv_1m', 'clv_6m', 'clv_12m'))}, round(scaled_1m, 7) AS scaled_1m, round(scaled_12m, 7) AS scaled_12m,
           substr('DCBA', {S.quantile_bin('clv_6m', 'valued', 4)}, 1) AS segment FROM scaled""",
)
def value_forecasts(spark, folder):
    """Discounted value of one, six and twelve months at fixed parameters, in thousands, scaled, with its quarter."""
    found = cltv.with_value_segment(_at_fixed_parameters(spark, folder), "clv_6m")
    return found.select(
        "customer_id",
        *[F.round(F.col(c) / 1000, 4).alias(c) for c in ("clv_1m", "clv_6m", "clv_12m")],
        *[F.round(f"scaled_clv_{n}m", 7).alias(f"scaled_{n}m") for n in (1, 12)],
        "segment",
    )


@query(
    "C15 T2",
    f"""WITH {S.CLIPPED}, {_FEATURES}, {_FORECAST},
    placed AS (SELECT customer_id, row_number() OVER (ORDER BY scaled_1m DESC, customer_id) AS one, row_number() OVER (ORDER BY scaled_12m DESC, customer_id) AS twelve FROM scaled)
    SELECT CAST(a.one AS INT) AS position, a.customer_id AS first, b.customer_id AS second, a.customer_id = b.customer_id AS same
    FROM placed a JOIN placed b ON a.one = b.twelve WHERE a.one <= 10""",
)
def forecast_leaders(spark, folder):
    """The ten best customers over one month and over twelve, side by side."""
    return probabilistic.same_leaders(_at_fixed_parameters(spark, folder), "scaled_clv_1m", "scaled_clv_12m")


def _valued_segments(spark, folder):
    """Calculated value joined with the behavioural segment."""
    valued = cltv.calculated_value(views.retail_lines(spark, folder, sold_only=True))
    behaviour = segmented(spark, folder).select("customer_id", F.col("segment").alias("rfm_segment"))
    return reused(behaviour.join(valued.select("customer_id", "scaled_cltv", F.col("segment").alias("value_segment")), "customer_id"))


_VALUED = f"""{S.CLIPPED}, {S.SCORES},
base AS (SELECT customer_id, count(DISTINCT invoice) AS tx, sum(quantity * price) AS total FROM clean GROUP BY customer_id),
raw AS (SELECT customer_id, total / tx * (tx / (SELECT count(*) FROM base)) / (SELECT 1 - count(*) FILTER (tx > 1) / count(*) FROM base) * (total * 0.1) AS cltv FROM base),
scaled AS (SELECT customer_id, (cltv - (SELECT min(cltv) FROM raw)) / (SELECT max(cltv) - min(cltv) FROM raw) AS scaled_cltv FROM raw),
valued AS (SELECT customer_id, scaled_cltv, substr('DCBA', {S.quantile_bin('scaled_cltv', 'scaled', 4)}, 1) AS value_segment FROM scaled),
final AS (SELECT segmented.customer_id, segment AS rfm_segment, scaled_cltv, value_segment FROM segmented JOIN valued ON segmented.customer_id = valued.customer_id)"""


@query("C12 A5 J3", f"WITH {_VALUED} SELECT value_segment, rfm_segment, count(*) AS count FROM final GROUP BY ALL")
def value_by_behaviour_segment(spark, folder):
    return frequency_table(_valued_segments(spark, folder), "value_segment", "rfm_segment")


@query(
    "T3 C12",
    f"""WITH {_VALUED}, placed AS (SELECT *, row_number() OVER (ORDER BY scaled_cltv DESC, customer_id) AS rk, count(*) OVER () AS n FROM final)
    SELECT rfm_segment, count(*) AS count FROM placed WHERE rk <= floor(n * 0.2) GROUP BY rfm_segment""",
)
def top_fifth_by_segment(spark, folder):
    best = top_share(_valued_segments(spark, folder), [("scaled_cltv", True), ("customer_id", False)], 0.2)
    return frequency_table(best, "rfm_segment")


@query(
    "T4 T1",
    f"""WITH {_VALUED}, placed AS (SELECT *, row_number() OVER (PARTITION BY rfm_segment ORDER BY scaled_cltv DESC, customer_id) AS rk,
      count(*) OVER (PARTITION BY rfm_segment) AS n FROM final)
    SELECT customer_id, rfm_segment FROM placed WHERE rk <= round_even(n * 0.2, 0)""",
)
def top_fifth_within_segment(spark, folder):
    best = top_share(_valued_segments(spark, folder), [("scaled_cltv", True), ("customer_id", False)], 0.2, ["rfm_segment"], "even")
    return best.select("customer_id", "rfm_segment")
