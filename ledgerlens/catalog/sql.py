"""SQL text shared by the statements: views, and rules written as expressions."""

from __future__ import annotations

from ledgerlens.functions.exprs import SPOTS
from ledgerlens.plans.rfm import SEGMENTS
from ledgerlens.sources.views import COURSE_TODAY, TODAY

RETAIL = """retail AS (
  SELECT (CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END) || CAST(l_orderkey AS VARCHAR) AS invoice,
         CAST(l_partkey AS VARCHAR) AS stock_code, p_name AS description, CAST(l_quantity AS BIGINT) AS quantity,
         l_extendedprice / l_quantity AS price, o_orderdate AS invoice_date, o_custkey AS customer_id,
         n_name AS country, p_brand AS brand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

CLEAN = (
    RETAIL
    + """,
clean AS (SELECT * FROM retail WHERE invoice NOT LIKE '%C%' AND quantity > 0 AND price > 0
          AND description IS NOT NULL AND invoice_date IS NOT NULL AND customer_id IS NOT NULL AND country IS NOT NULL)"""
)


def fence(table: str, column: str, low: float = 0.01, high: float = 0.99) -> str:
    """A common table expression with the fences of one column."""
    q1, q3 = f"quantile_cont({column}, {low})", f"quantile_cont({column}, {high})"
    return f"fence_{column} AS (SELECT {q1} - 1.5 * ({q3} - {q1}) AS lo, {q3} + 1.5 * ({q3} - {q1}) AS hi FROM {table})"


CLIPPED = (
    CLEAN
    + ", "
    + fence("clean", "price")
    + ", "
    + fence("clean", "quantity")
    + """,
clipped AS (SELECT clean.* EXCLUDE (price, quantity),
                   greatest(fp.lo, least(fp.hi, price)) AS price,
                   greatest(fq.lo, least(fq.hi, CAST(quantity AS DOUBLE))) AS quantity
            FROM clean, fence_price fp, fence_quantity fq)"""
)


def single(expression: str) -> str:
    """A figure at single precision (see the registry)."""
    return f"CAST(CAST({expression} AS FLOAT) AS DOUBLE)"


def rfm(lines: str = "clipped") -> str:
    return f"""rfm AS (
  SELECT customer_id, CAST(floor((epoch(TIMESTAMP '{TODAY}') - epoch(max(invoice_date))) / 86400) AS BIGINT) AS recency,
         count(DISTINCT invoice) AS frequency, sum(quantity * price) AS monetary
  FROM {lines} GROUP BY customer_id HAVING sum(quantity * price) > 0)"""


def key_spot(key: str, seed: int, factor: int) -> str:
    """The repeatable number in [0, 1) of a whole-number key."""
    whole = f"((({key} % {SPOTS}) + {SPOTS}) % {SPOTS})"
    return f"((CAST({whole} AS BIGINT) * {factor} + {seed * 69_069}) % {SPOTS}) / {float(SPOTS)}"


def quantile_bin(value: str, table: str, bins: int) -> str:
    """1 + number of inner quantile edges below the value."""
    parts = " + ".join(
        f"CAST({value} > (SELECT quantile_cont({value}, {i}/{bins}.0) FROM {table}) AS INT)" for i in range(1, bins)
    )
    return f"(1 + {parts})"


def segment_case(code: str, names: dict[str, str] | None = None) -> str:
    arms = " ".join(f"WHEN regexp_full_match({code}, '{p}') THEN '{n}'" for p, n in (names or SEGMENTS).items())
    return f"CASE {arms} END"


SCORES = (
    rfm()
    + f""",
ranked AS (SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS rk, count(*) OVER () AS n FROM rfm),
scored AS (SELECT customer_id, recency, frequency, monetary,
                  6 - {quantile_bin('recency', 'rfm', 5)} AS recency_score,
                  CAST(greatest(1, ((rk - 1) * 5 + n - 2) // (n - 1)) AS INT) AS frequency_score,
                  {quantile_bin('monetary', 'rfm', 5)} AS monetary_score FROM ranked),
segmented AS (SELECT *, CAST(recency_score AS VARCHAR) || CAST(frequency_score AS VARCHAR) AS rfm_score,
                     {segment_case("CAST(recency_score AS VARCHAR) || CAST(frequency_score AS VARCHAR)")} AS segment
              FROM scored)"""
)

RATINGS = """ratings AS (
  SELECT o_custkey AS user_id, p_name AS title, CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS rating, l_shipdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

PROFILE = """prof AS (
  SELECT c_custkey AS id, nullif(c_mktsegment, 'MACHINERY') AS mktsegment,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS acctbal,
         CAST(c_nationkey AS BIGINT) AS nationkey, n_orders, spend,
         CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS target
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders,
                                  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend
                           FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)"""

COURSE = (
    RATINGS
    + f""",
course AS (SELECT title, rating, user_id % 101 AS progress,
                  CAST(floor((epoch(TIMESTAMP '{COURSE_TODAY}') - epoch(ts)) / 86400) AS BIGINT) AS days FROM ratings)"""
)

VOTES = """votes AS (SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup')) AS up,
                 count(*) FILTER (event_type = 'error') AS down FROM events GROUP BY user_id)"""


def _banded(number: str) -> str:
    return f"CASE WHEN ({number}) % 3 = 0 THEN 'Yes' WHEN ({number}) % 3 = 1 THEN 'No' ELSE 'No service' END"


SERVICES = f"""services AS (
  SELECT p_partkey AS id, {_banded('p_size')} AS backup, {_banded("CAST(regexp_extract(p_brand, '[0-9]+$') AS BIGINT)")} AS support,
         {_banded('length(p_type)')} AS streaming, p_type AS plan FROM part)"""

SCORED = """scored AS (SELECT event_id, value / (SELECT max(value) FROM events) AS score,
                CAST(event_type = 'purchase' AS INT) AS label FROM events)"""
