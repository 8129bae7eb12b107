"""Rating scores, joins, selections and record clean-up."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ledgerlens.catalog import sql as S
from ledgerlens.catalog.registry import query, single
from ledgerlens.functions import scores
from ledgerlens.functions.exprs import PICK_FACTOR
from ledgerlens.operators import clean
from ledgerlens.plans import levels, records
from ledgerlens.plans.cltv import min_max_scaled
from ledgerlens.session import reused, scratch_path
from ledgerlens.sources import tables, views
from ledgerlens.sources.tables import parquet_table

Z = NormalDist().inv_cdf(0.975)


def _time():
    return (
        "avg(rating) FILTER (days <= 30) * 28 / 100 + avg(rating) FILTER (days > 30 AND days <= 90) * 26 / 100 + "
        "avg(rating) FILTER (days > 90 AND days <= 180) * 24 / 100 + avg(rating) FILTER (days > 180) * 22 / 100"
    )


_PROGRESS = (
    "avg(rating) FILTER (progress <= 10) * 22 / 100 + avg(rating) FILTER (progress > 10 AND progress <= 45) * 24 / 100 + "
    "avg(rating) FILTER (progress > 45 AND progress <= 75) * 26 / 100 + avg(rating) FILTER (progress > 75) * 28 / 100"
)


@query("K1 K2 K3", f"WITH {S.COURSE} SELECT round({_time()}, 6) AS time_weighted, round({_PROGRESS}, 6) AS user_weighted, round(({_time()}) * 0.5 + ({_PROGRESS}) * 0.5, 6) AS course_rating FROM course")
def course_rating(spark, folder):
    found = scores.course_ratings(views.course_lines(spark, folder))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(
    "K1 K2 K3",
    f"WITH {S.COURSE} SELECT title, round({_time()}, 6) AS time_weighted, round({_PROGRESS}, 6) AS user_weighted, round(({_time()}) * 0.5 + ({_PROGRESS}) * 0.5, 6) AS course_rating FROM course GROUP BY title",
)
def course_rating_by_title(spark, folder):
    found = scores.course_ratings(views.course_lines(spark, folder), ["title"])
    return found.select("title", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


_STARS = f"""{S.RATINGS},
stars AS (SELECT title, count(*) FILTER (rating = 1) AS s1, count(*) FILTER (rating = 2) AS s2, count(*) FILTER (rating = 3) AS s3,
                 count(*) FILTER (rating = 4) AS s4, count(*) FILTER (rating = 5) AS s5, count(*) AS n_ratings,
                 count(DISTINCT user_id) AS n_users, avg(rating) AS rating FROM ratings GROUP BY title),
scaled AS (SELECT *, (n_ratings - min(n_ratings) OVER ()) / (max(n_ratings) OVER () - min(n_ratings) OVER ()) AS comments,
                  (n_users - min(n_users) OVER ()) / (max(n_users) OVER () - min(n_users) OVER ()) AS purchases,
                  CAST(s1 + s2 + s3 + s4 + s5 AS DOUBLE) AS n FROM stars),
parts AS (SELECT *, ((s1 + 1) + 2 * (s2 + 1) + 3 * (s3 + 1) + 4 * (s4 + 1) + 5 * (s5 + 1)) / (n + 5) AS first,
                 ((s1 + 1) + 4 * (s2 + 1) + 9 * (s3 + 1) + 16 * (s4 + 1) + 25 * (s5 + 1)) / (n + 5) AS second FROM scaled),
final AS (SELECT title, CASE WHEN n = 0 THEN 0 ELSE first - {Z!r} * sqrt((second - first * first) / (n + 6)) END AS bayesian,
                 comments * 0.32 + purchases * 0.26 + rating * 0.42 AS sorting FROM parts)"""


@query(
    "K4 K5 K6 F8 U3",
    f"WITH {_STARS} SELECT title, round(bayesian, 6) AS bayesian, round(sorting, 6) AS sorting, round(bayesian * 0.6 + sorting * 0.4, 6) AS hybrid FROM final",
)
def title_sorting_scores(spark, folder):
    stars = reused(views.star_counts(views.ratings(spark, folder)))
    scaled = min_max_scaled(stars, {"n_ratings": "comments", "n_users": "purchases"})
    counts = [F.col(f"stars_{k}") for k in range(1, 6)]
    return scaled.select(
        "title",
        F.round(scores.bayesian_average_rating(counts), 6).alias("bayesian"),
        F.round(scores.weighted_sorting_score(F.col("comments"), F.col("purchases"), F.col("rating")), 6).alias("sorting"),
        F.round(scores.hybrid_sorting_score(counts, F.col("comments"), F.col("purchases"), F.col("rating")), 6).alias("hybrid"),
    )


@query(
    "K7",
    f"""WITH {S.RATINGS}, t AS (SELECT title, count(*) AS v, avg(rating) AS r FROM ratings GROUP BY title)
    SELECT title, round(v / (v + 1000) * r + 1000 / (v + 1000) * (SELECT avg(rating) FROM ratings), 6) AS score FROM t""",
)
def shrunk_title_ratings(spark, folder):
    rated = views.ratings(spark, folder)
    overall = rated.agg(F.avg("rating")).scalar()
    grouped = rated.groupBy("title").agg(F.count(F.lit(1)).alias("v"), F.avg("rating").alias("r"))
    return grouped.select("title", F.round(scores.shrunk_rating(F.col("r"), F.col("v"), F.lit(1000), overall), 6).alias("score"))


@query(
    "K8 K9 K10",
    f"""WITH {S.VOTES} SELECT user_id, up, down, up - down AS difference,
    round(CASE WHEN up + down = 0 THEN 0 ELSE up / (up + down) END, 6) AS share,
    round(CASE WHEN up + down = 0 THEN 0 ELSE (up / (up + down) + {Z * Z!r} / (2 * (up + down)) - {Z!r} * sqrt((up / (up + down) * (1 - up / (up + down))
      + {Z * Z!r} / (4 * (up + down))) / (up + down))) / (1 + {Z * Z!r} / (up + down)) END, 6) AS wilson FROM votes""",
)
def vote_scores(spark, folder):
    up, down = F.col("up"), F.col("down")
    return views.votes(spark, folder).select(
        "user_id",
        "up",
        "down",
        scores.up_down_difference(up, down).alias("difference"),
        F.round(scores.up_share(up, down), 6).alias("share"),
        F.round(scores.wilson_lower_bound(up, down), 6).alias("wilson"),
    )


@query("J1 A1", "SELECT p_partkey AS id, p_name AS title, count(l_orderkey) AS ratings, max(l_quantity) AS top FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL")
def titles_with_ratings(spark, folder):
    line = parquet_table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("top"))
    part = parquet_table(spark, folder, "part")
    joined = part.join(line, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.coalesce("n", F.lit(0)).alias("ratings"), "top")


@query(
    "J6 J7 X1 X3",
    """SELECT 'bought' AS kind, count(*) AS customers FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    UNION ALL SELECT 'not bought', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def urgent_buyers(spark, folder):
    customer = parquet_table(spark, folder, "customer")
    urgent = parquet_table(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    count = F.count(F.lit(1)).alias("customers")
    bought = customer.join(urgent, "c_custkey", "left_semi").agg(count).select(F.lit("bought").alias("kind"), "customers")
    rest = customer.join(urgent, "c_custkey", "left_anti").agg(count).select(F.lit("not bought").alias("kind"), "customers")
    return tables.appended([bought, rest])


@query(
    "J8",
    """SELECT coalesce(c.c_custkey, o.o_custkey) AS customer_id, c.c_mktsegment AS segment, o.orders, o.spend
    FROM (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0) c
    FULL JOIN (SELECT o_custkey, count(*) AS orders, round(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 2) AS spend FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) o ON c_custkey = o_custkey""",
)
def customers_beside_totals(spark, folder):
    """Customers with credit and totals of open orders side by side by key, rows of either kept."""
    customer, order = parquet_table(spark, folder, "customer"), parquet_table(spark, folder, "orders")
    left = customer.filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    spend = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spend")
    right = order.filter(F.col("o_orderstatus") == "O").groupBy(F.col("o_custkey").alias("customer_id")).agg(F.count(F.lit(1)).alias("orders"), spend)
    return left.join(right, "customer_id", "full")


@query("X2", "SELECT DISTINCT p_name AS title, p_brand AS brand FROM part")
def distinct_titles(spark, folder):
    """Each pair of values once."""
    return parquet_table(spark, folder, "part").select(F.col("p_name").alias("title"), F.col("p_brand").alias("brand")).distinct()


@query(
    "J3 J4",
    """SELECT o_orderkey AS order_id, c_name AS name, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def orders_with_names(spark, folder):
    order, customer = parquet_table(spark, folder, "orders"), parquet_table(spark, folder, "customer")
    joined = order.join(customer, order["o_custkey"] == customer["c_custkey"]).drop("c_custkey")
    return joined.select(F.col("o_orderkey").alias("order_id"), F.col("c_name").alias("name"), F.col("o_totalprice").alias("price"))


@query("P18", "SELECT DISTINCT p_name AS title FROM part WHERE p_name LIKE '%ring%'")
def titles_with_keyword(spark, folder):
    return clean.titles_containing(parquet_table(spark, folder, "part").select(F.col("p_name").alias("title")), "title", "ring")


@query(
    "P19",
    f"WITH {S.RETAIL} SELECT stock_code, arg_min(description, (invoice, description)) AS description FROM retail GROUP BY stock_code",
)
def item_descriptions(spark, folder):
    lines = views.retail_lines(spark, folder)
    return clean.first_per_key(lines, "stock_code", "description", ["invoice", "description"])


@query("P17", f"SELECT o_custkey AS user_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey ORDER BY {S.key_spot('o_custkey', 101, PICK_FACTOR)}, o_custkey LIMIT 1")
def picked_user(spark, folder):
    return clean.pick_one(views.ratings(spark, folder), "user_id", 101)


_LEVELS = """spending AS (
  SELECT c_custkey AS id, upper(trim(n_name)) || '_' || upper(trim(o_orderpriority)) || '_' || upper(trim(o_orderstatus)) || '_' ||
         CASE WHEN c_custkey % 101 <= 18 THEN '0_18' WHEN c_custkey % 101 <= 23 THEN '19_23' WHEN c_custkey % 101 <= 30 THEN '24_30'
              WHEN c_custkey % 101 <= 40 THEN '31_40' WHEN c_custkey % 101 <= 66 THEN '41_66' ELSE '67_100' END AS persona, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
levels AS (SELECT persona, avg(o_totalprice) AS price FROM spending GROUP BY persona)"""


def _spending(spark, folder):
    order, customer, nation = (parquet_table(spark, folder, t) for t in ("orders", "customer", "nation"))
    joined = order.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key = levels.persona_key([F.col("n_name"), F.col("o_orderpriority"), F.col("o_orderstatus")], F.col("c_custkey") % 101)
    return joined.select(F.col("c_custkey").alias("id"), key.alias("persona"), "o_totalprice")


@query(
    "C16 W5 F3 F4",
    f"WITH {_LEVELS} SELECT persona, {S.single('price')} AS price, substr('DCBA', {S.quantile_bin('price', 'levels', 4)}, 1) AS segment FROM levels",
)
def level_table(spark, folder):
    found = levels.level_table(_spending(spark, folder), "persona", "o_totalprice")
    return found.select("persona", single(F.col("price")).alias("price"), "segment")


@query(
    "C16 J1",
    f"""WITH {_LEVELS}, graded AS (SELECT persona, substr('DCBA', {S.quantile_bin('price', 'levels', 4)}, 1) AS segment FROM levels),
    users AS (SELECT c_custkey AS id, upper(trim(n_name)) || '_1-URGENT_P_' ||
         CASE WHEN c_custkey % 101 <= 18 THEN '0_18' WHEN c_custkey % 101 <= 23 THEN '19_23' WHEN c_custkey % 101 <= 30 THEN '24_30'
              WHEN c_custkey % 101 <= 40 THEN '31_40' WHEN c_custkey % 101 <= 66 THEN '41_66' ELSE '67_100' END AS persona
         FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT id, users.persona, segment, segment IS NOT NULL AS has_data FROM users LEFT JOIN graded ON users.persona = graded.persona""",
)
def level_lookup(spark, folder):
    customer, nation = parquet_table(spark, folder, "customer"), parquet_table(spark, folder, "nation")
    key = levels.persona_key([F.concat(F.lit(" "), F.lower("n_name")), F.lit("1-urgent"), F.lit("p ")], F.col("c_custkey") % 101)
    users = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), key.alias("persona"))
    found = levels.looked_up(users, levels.level_table(_spending(spark, folder), "persona", "o_totalprice"), "persona")
    return found.select("id", "persona", "segment", "has_data")


def _film_records(spark, folder):
    """Parts as landed film records with printed nested fields."""
    part = parquet_table(spark, folder, "part")
    word = F.split("p_name", " ")
    two = F.format_string("[{'id': %d, 'name': '%s'}, {'id': 7, 'name': \"%s's\"}]", F.col("p_size"), word[0], word[1])
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        two.alias("genres"),
        F.when(F.col("p_partkey") % 3 == 0, F.format_string("{'id': %d, 'name': '%s', 'poster_path': None}", F.col("p_partkey"), F.col("p_brand"))).alias("belongs_to_collection"),
        F.lit(5.0).alias("vote_average"),
        F.col("p_size").alias("vote_count"),
        F.lit(0).alias("budget"),
        F.lit(0).alias("revenue"),
        F.col("p_retailprice").alias("popularity"),
        F.format_string("[{'name': '%s', 'adult': False}]", F.col("p_type")).alias("production_companies"),
        F.lit("[]").alias("production_countries"),
        F.when(F.col("p_size") > 3, "1995-11-04").otherwise("unknown").alias("release_date"),
        F.lit(90).alias("runtime"),
        F.lit("[{'name': 'None'}, {'name': 'True'}]").alias("spoken_languages"),
        (F.col("p_size") % 10 == 0).alias("adult"),
    )


@query(
    "L27 F5 P4 P9 P12 U4",
    """SELECT p_partkey AS id, p_name AS title, split_part(p_name, ' ', 1) || ', ' || split_part(p_name, ' ', 2) || '''s' AS genres,
    CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'No' END AS belongs_to_collection, p_type AS production_companies,
    '' AS production_countries, 'None, True' AS spoken_languages, CASE WHEN p_size > 3 THEN '1995-11-04' END AS released, 0 AS unreadable
    FROM part WHERE NOT (p_size % 10 = 0)""",
)
def film_records_cleaned(spark, folder):
    found = records.sorted_by_id(records.clean_records(_film_records(spark, folder)))
    return found.select(
        "id", "title", "genres", "belongs_to_collection", "production_companies", "production_countries", "spoken_languages",
        F.date_format("release_date", "yyyy-MM-dd").alias("released"), "unreadable",
    )


@query("S1 S6 S10", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, folder):
    path = scratch_path(spark, "customers-csv")
    tables.write_csv(parquet_table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return tables.csv_table(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query(
    "S5 X1",
    """SELECT 'supplier' AS kind, s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier
    UNION ALL SELECT 'customer', c_custkey, c_name, NULL, c_mktsegment FROM customer""",
)
def landed_json_records(spark, folder):
    supplier = parquet_table(spark, folder, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    customer = parquet_table(spark, folder, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    read = []
    for batch, schema in ((supplier, "kind string, id long, name string, balance double"), (customer, "kind string, id long, name string, segment string")):
        path = scratch_path(spark, "records-json")
        batch.write.json(path)
        read.append(tables.json_records(spark, path, schema))
    return tables.appended(read)


@query("S3 S7 S10", f"WITH {S.CLIPPED}, {S.SCORES} SELECT customer_id, recency, frequency FROM segmented WHERE segment = 'champions'")
def segment_export(spark, folder):
    from ledgerlens.catalog.segments import segmented

    path = scratch_path(spark, "segments")
    tables.write_parquet(segmented(spark, folder).select("customer_id", "recency", "frequency", "segment"), path, ["segment"])
    return spark.read.parquet(path).filter(F.col("segment") == "champions").select("customer_id", "recency", "frequency")
