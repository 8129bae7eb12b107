"""Baskets, rules and recommenders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalog import sql as S
from ledgerlens.catalog.registry import query
from ledgerlens.operators.clean import first_per_key
from ledgerlens.plans import basket, content, recommend
from ledgerlens.plans.rfm import clean_lines
from ledgerlens.session import reused
from ledgerlens.sources import views
from ledgerlens.sources.tables import parquet_table

USER = 1
POPULAR = 900


def _pairs(spark, folder, country=None):
    return basket.basket_items(clean_lines(views.retail_lines(spark, folder, sold_only=True)), "brand", country, parts=views.line_parts(spark, folder))


_PAIRS = f"""{S.CLEAN},
pairs AS (SELECT invoice, brand AS item FROM clean WHERE stock_code <> 'POST' GROUP BY invoice, brand HAVING sum(quantity) > 0)"""

# Sets of up to four items; at this support no set of four exists, so all frequent sets are covered.
_SETS = f"""{_PAIRS},
total AS (SELECT count(DISTINCT invoice) AS n FROM pairs),
ones AS (SELECT item AS a, count(*) AS c FROM pairs GROUP BY item HAVING count(*) >= 0.01 * (SELECT n FROM total)),
kept AS (SELECT * FROM pairs WHERE item IN (SELECT a FROM ones)),
twos AS (SELECT x.item AS a, y.item AS b, count(*) AS c FROM kept x JOIN kept y ON x.invoice = y.invoice AND x.item < y.item
         GROUP BY ALL HAVING count(*) >= 0.01 * (SELECT n FROM total)),
threes AS (SELECT x.item AS a, y.item AS b, z.item AS d, count(*) AS c FROM kept x JOIN kept y ON x.invoice = y.invoice AND x.item < y.item
           JOIN kept z ON x.invoice = z.invoice AND y.item < z.item GROUP BY ALL HAVING count(*) >= 0.01 * (SELECT n FROM total)),
fours AS (SELECT 1 AS c FROM kept x JOIN kept y ON x.invoice = y.invoice AND x.item < y.item JOIN kept z ON x.invoice = z.invoice AND y.item < z.item
          JOIN kept w ON x.invoice = w.invoice AND z.item < w.item GROUP BY x.item, y.item, z.item, w.item
          HAVING count(*) >= 0.01 * (SELECT n FROM total)),
sets AS (SELECT a AS items, 1 AS size, c, c / n AS support FROM ones, total UNION ALL SELECT a || '+' || b, 2, c, c / n FROM twos, total
         UNION ALL SELECT a || '+' || b || '+' || d, 3, c, c / n FROM threes, total
         UNION ALL SELECT 'four', 4, c, 0 FROM fours),
splits AS (SELECT a AS l, b AS r, a || '+' || b AS items FROM twos UNION ALL SELECT b, a, a || '+' || b FROM twos
           UNION ALL SELECT a, b || '+' || d, a || '+' || b || '+' || d FROM threes UNION ALL SELECT b, a || '+' || d, a || '+' || b || '+' || d FROM threes
           UNION ALL SELECT d, a || '+' || b, a || '+' || b || '+' || d FROM threes UNION ALL SELECT a || '+' || b, d, a || '+' || b || '+' || d FROM threes
           UNION ALL SELECT a || '+' || d, b, a || '+' || b || '+' || d FROM threes UNION ALL SELECT b || '+' || d, a, a || '+' || b || '+' || d FROM threes),
rules AS (SELECT l, r, sl.support AS left_support, sr.support AS right_support, s.support, s.support / sl.support AS confidence,
                 s.support / sl.support / sr.support AS lift
          FROM splits JOIN sets s ON s.items = splits.items JOIN sets sl ON sl.items = l JOIN sets sr ON sr.items = r)"""


def _text(items):
    return F.array_join(items, "+")


@query(
    "B1 X5 A2",
    f"WITH {_PAIRS} SELECT item, count(*) AS invoices FROM pairs GROUP BY item",
)
def basket_item_counts(spark, folder):
    return _pairs(spark, folder).groupBy("item").agg(F.count(F.lit(1)).alias("invoices"))


_BRANDS = tuple(f"Brand#{k}" for k in range(1, 26))  # all items of the tables, in the order of their columns


@query(
    "B1 X5 U2",
    f"WITH {_PAIRS} SELECT invoice, "
    + ", ".join(f"""max(CAST(item = '{b}' AS INT)) AS "{b}\"""" for b in _BRANDS)
    + " FROM pairs GROUP BY invoice",
)
def basket_flags(spark, folder):
    """Invoice by item, for every item."""
    return basket.basket_flags(_pairs(spark, folder), list(_BRANDS))


@query(
    "B1",
    f"WITH {S.CLEAN}, pairs AS (SELECT country, invoice, brand AS item FROM clean GROUP BY ALL HAVING sum(quantity) > 0) "
    "SELECT item, count(*) AS invoices FROM pairs WHERE country = 'NATION_7' GROUP BY item",
)
def basket_of_one_country(spark, folder):
    """Invoices with each item, of the lines of one country."""
    return _pairs(spark, folder, "NATION_7").groupBy("item").agg(F.count(F.lit(1)).alias("invoices"))


@query("B2", f"WITH {_SETS} SELECT items, size, c AS count, round(support, 8) AS support FROM sets")
def frequent_item_sets(spark, folder):
    found = basket.frequent_sets(_pairs(spark, folder))
    return found.select(_text("items").alias("items"), F.size("items").alias("size"), "count", F.round("support", 8).alias("support"))


@query(
    "B3",
    f"""WITH {_SETS} SELECT l AS antecedents, r AS consequents, round(left_support, 8) AS antecedent_support,
    round(right_support, 8) AS consequent_support, round(support, 8) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift,
    round(support - left_support * right_support, 8) AS leverage, round((1 - right_support) / (1 - confidence), 6) AS conviction FROM rules""",
)
def association_rules(spark, folder):
    rules = basket.association_rules(basket.frequent_sets(_pairs(spark, folder)))
    eight = ("antecedent_support", "consequent_support", "support", "leverage")
    return rules.select(
        _text("antecedents").alias("antecedents"),
        _text("consequents").alias("consequents"),
        *[F.round(c, 8).alias(c) for c in eight],
        *[F.round(c, 6).alias(c) for c in ("confidence", "lift", "conviction")],
    )


_DESCRIBED = "names AS (SELECT brand, arg_min(description, (invoice, description)) AS description FROM clean GROUP BY brand)"


@query(
    "B4 P19 X3",
    f"""WITH {_SETS}, {_DESCRIBED},
    sides AS (SELECT unnest(string_split(l, '+')) AS item, string_split(r, '+')[1] AS recommended, support FROM rules),
    best AS (SELECT item, recommended, max(support) AS score FROM sides GROUP BY ALL)
    SELECT item, recommended, round(score, 8) AS score, description,
           row_number() OVER (PARTITION BY item ORDER BY round(score, 10) DESC, recommended) AS position
    FROM best LEFT JOIN names ON recommended = brand""",
)
def recommended_by_support(spark, folder):
    lines = clean_lines(views.retail_lines(spark, folder, sold_only=True))
    rules = basket.association_rules(basket.frequent_sets(basket.basket_items(lines, "brand")))
    found = basket.recommended_items(rules, "support")
    names = first_per_key(lines, "brand", "description", ["invoice", "description"])
    described = basket.with_description(found, names, "brand", "description")
    return described.select("item", "recommended", F.round("score", 8).alias("score"), "description", F.col("position").cast("long").alias("position"))


@query(
    "B5",
    f"""WITH {_SETS}, sides AS (SELECT unnest(string_split(l, '+')) AS item, r, lift FROM rules),
    flat AS (SELECT item, unnest(string_split(r, '+')) AS recommended, lift FROM sides),
    best AS (SELECT item, recommended, max(lift) AS score FROM flat GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(score, 10) DESC, recommended) AS position FROM best)
    SELECT item, recommended, round(score, 6) AS score, position FROM ranked WHERE position <= 3""",
)
def recommended_by_lift(spark, folder):
    rules = basket.association_rules(basket.frequent_sets(_pairs(spark, folder)))
    found = basket.recommended_items(rules, "lift", first_only=False, count=3)
    return found.select("item", "recommended", F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position"))


_UT = f"""{S.RATINGS},
popular AS (SELECT title FROM ratings GROUP BY title HAVING count(*) > {POPULAR}),
ut AS (SELECT user_id, title, avg(rating) AS rating FROM ratings WHERE title IN (SELECT title FROM popular) GROUP BY user_id, title)"""

_SHARED = f"""{_UT},
own AS (SELECT title, rating AS own FROM ut WHERE user_id = {USER}),
shared AS (SELECT user_id, count(*) AS shared, corr(rating, own) AS r FROM ut JOIN own USING (title) GROUP BY user_id),
bins AS (SELECT *, CASE WHEN lo = hi THEN 50 ELSE greatest(1, ceil((shared - lo) * 100 / (hi - lo))) END AS bin
         FROM shared, (SELECT min(shared) AS lo, max(shared) AS hi FROM shared))"""


def _neighbours(condition: str, corr: float) -> str:
    return f"""{_SHARED}, near AS (SELECT user_id, shared, r AS corr FROM bins WHERE {condition} AND user_id <> {USER}
               AND shared >= 2 AND NOT isnan(r) AND round(r, 10) >= {corr})"""


def _scores(condition: str, corr: float) -> str:
    return f"""{_neighbours(condition, corr)},
    scores AS (SELECT title, avg(corr * rating) AS score FROM ratings JOIN near USING (user_id) GROUP BY title)"""


def _ranked(table: str, score: str, count: int) -> str:
    return f"(SELECT title, {score}, row_number() OVER (ORDER BY round({score}, 10) DESC, title) AS position FROM {table} QUALIFY position <= {count})"


_ITEM = f"""seed AS (SELECT arg_max(title, (ts, title)) AS title FROM ratings WHERE user_id = {USER}
                     AND rating = (SELECT max(rating) FROM ratings) AND title IN (SELECT title FROM ut WHERE user_id = {USER})),
base AS (SELECT user_id, rating AS seed_rating FROM ut WHERE title = (SELECT title FROM seed)),
corrs AS (SELECT title, count(*) AS common, corr(rating, seed_rating) AS corr FROM ut JOIN base USING (user_id) GROUP BY title),
items AS (SELECT * FROM corrs WHERE common >= 2 AND NOT isnan(corr))"""


def _rated(spark, folder):
    return reused(views.ratings(spark, folder))


def _ut(spark, folder):
    rated = _rated(spark, folder)
    return rated, reused(recommend.user_titles(rated, POPULAR))


@query("R1 X4 A1", f"WITH {_UT} SELECT user_id, title, round(rating, 6) AS rating FROM ut")
def user_title_ratings(spark, folder):
    return recommend.user_titles(views.ratings(spark, folder), POPULAR).withColumn("rating", F.round("rating", 6))


@query("R2 W3", f"WITH {_SHARED} SELECT user_id, shared, CAST(bin AS INT) AS bin FROM bins")
def shared_title_counts(spark, folder):
    _, titles = _ut(spark, folder)
    counts = reused(recommend.shared_counts(titles, USER))
    return counts.select("user_id", "shared", recommend.sharing_bin(counts).alias("bin"))


@query("R2 R3", f"WITH {_neighbours('bin > 60', 0.6)} SELECT user_id, shared, round(corr, 6) AS corr FROM near")
def neighbours_above_bin(spark, folder):
    _, titles = _ut(spark, folder)
    return recommend.neighbours(titles, USER, 0.60, above_bin=60).select("user_id", "shared", F.round("corr", 6).alias("corr"))


@query("R2 R3", f"WITH {_neighbours('shared > 8', 0.65)} SELECT user_id, shared, round(corr, 6) AS corr FROM near")
def neighbours_above_count(spark, folder):
    _, titles = _ut(spark, folder)
    return recommend.neighbours(titles, USER, 0.65, more_than=8).select("user_id", "shared", F.round("corr", 6).alias("corr"))


@query(
    "R4 J3 J4",
    f"WITH {_scores('bin > 60', 0.6)} SELECT title, round(score, 6) AS score, position FROM {_ranked('scores', 'score', 5)}",
)
def user_based_top(spark, folder):
    rated, titles = _ut(spark, folder)
    similar = recommend.neighbours(titles, USER, 0.60, above_bin=60)
    found = recommend.ranked(recommend.user_based_scores(rated, similar), "score", 5)
    return found.select("title", F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position"))


@query(
    "R4",
    f"WITH {_scores('shared > 8', 0.65)} SELECT title, round(score, 6) AS score FROM scores WHERE score > 2.3",
)
def user_based_above_score(spark, folder):
    rated, titles = _ut(spark, folder)
    similar = recommend.neighbours(titles, USER, 0.65, more_than=8)
    scored = recommend.user_based_scores(rated, similar)
    return scored.filter(F.col("score") > 2.3).select("title", F.round("score", 6).alias("score"))


@query(
    "R4 J7",
    f"""WITH {_scores('bin >= 50', 0.5)} SELECT title, round(score, 6) AS score FROM scores
    WHERE title NOT IN (SELECT title FROM ratings WHERE user_id = {USER})""",
)
def user_based_unseen(spark, folder):
    rated, titles = _ut(spark, folder)
    scored = recommend.user_based_scores(rated, recommend.neighbours(titles, USER, 0.50, min_bin=50))
    return recommend.without_seen(scored, rated, USER).withColumn("score", F.round("score", 6))


@query(
    "R5 T5",
    f"""WITH {_UT}, {_ITEM} SELECT title, common, round(corr, 6) AS corr, position
    FROM (SELECT title, common, corr, row_number() OVER (ORDER BY round(corr, 10) DESC, title) AS position FROM items
          WHERE title <> (SELECT title FROM seed) QUALIFY position <= 5)""",
)
def item_based_next(spark, folder):
    rated, titles = _ut(spark, folder)
    found = recommend.item_based(titles, recommend.seed_title(rated, titles, USER), 5)
    return found.select("title", "common", F.round("corr", 6).alias("corr"), F.col("position").cast("long").alias("position"))


@query("R5 E7", f"WITH {_UT}, {_ITEM} SELECT title, common, round(corr, 6) AS corr FROM items")
def item_correlations(spark, folder):
    rated, titles = _ut(spark, folder)
    found = recommend.title_correlations(titles, recommend.seed_title(rated, titles, USER))
    return found.select("title", "common", F.round("corr", 6).alias("corr"))


@query(
    "R5 T2",
    f"""WITH {_UT}, base AS (SELECT user_id, rating AS seed_rating FROM ut WHERE title = (SELECT min(title) FROM ut)),
    corrs AS (SELECT title, count(*) AS common, corr(rating, seed_rating) AS corr FROM ut JOIN base USING (user_id) GROUP BY title),
    items AS (SELECT * FROM corrs WHERE common >= 2 AND NOT isnan(corr))
    SELECT title, round(corr, 6) AS corr, position FROM {_ranked('items', 'corr', 10)}""",
)
def item_based_with_seed(spark, folder):
    _, titles = _ut(spark, folder)
    found = recommend.item_based(titles, titles.agg(F.min("title")).scalar(), 10, include_seed=True)
    return found.select("title", F.round("corr", 6).alias("corr"), F.col("position").cast("long").alias("position"))


@query(
    "R6 J5",
    f"""WITH {_scores('bin >= 50', 0.5)}, {_ITEM},
    u AS {_ranked('scores', 'score', 5)}, i AS (SELECT title, row_number() OVER (ORDER BY round(corr, 10) DESC, title) AS position FROM items
      WHERE title <> (SELECT title FROM seed) QUALIFY position <= 5),
    cat AS (SELECT p_name AS title, min(p_partkey) AS item_id FROM part GROUP BY p_name)
    SELECT coalesce(u.position, i.position) AS position, u.title AS user_based, i.title AS item_based,
           CASE WHEN cu.item_id % 5 <> 0 THEN cu.item_id * 10 END AS user_external, CASE WHEN ci.item_id % 5 <> 0 THEN ci.item_id * 10 END AS item_external
    FROM u FULL JOIN i ON u.position = i.position LEFT JOIN cat cu ON cu.title = u.title LEFT JOIN cat ci ON ci.title = i.title""",
)
def hybrid_recommendations(spark, folder):
    rated, titles = _ut(spark, folder)
    user_list = recommend.ranked(
        recommend.user_based_scores(rated, recommend.neighbours(titles, USER, 0.50, min_bin=50)), "score", 5
    )
    item_list = recommend.item_based(titles, recommend.seed_title(rated, titles, USER), 5)
    both = reused(recommend.hybrid(user_list, item_list))
    part = parquet_table(spark, folder, "part")
    catalogue = part.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("item_id"))
    links = part.select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") * 10).alias("external_id"))
    for side in ("user", "item"):
        ids = recommend.external_ids(both.select(F.col(f"{side}_based").alias("title")).filter(F.col("title").isNotNull()), catalogue, links)
        both = both.join(ids.select(F.col("title").alias(f"{side}_based"), F.col("external_id").alias(f"{side}_external")), f"{side}_based", "left")
    return both.select(F.col("position").cast("long").alias("position"), "user_based", "item_based", "user_external", "item_external")


def _content_sql() -> str:
    words = ", ".join(f"'{w}'" for w in content.STOP_WORDS)
    return f"""WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term NOT IN ({words}) GROUP BY ALL),
    idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term),
    w AS (SELECT doc_id, tf.term, tf * idf AS w FROM tf JOIN idf ON tf.term = idf.term),
    norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
    seed AS (SELECT term, w FROM w WHERE doc_id = 1),
    dots AS (SELECT w.doc_id, sum(w.w * seed.w) AS dot FROM w JOIN seed ON w.term = seed.term WHERE w.doc_id <> 1 GROUP BY w.doc_id),
    scored AS (SELECT doc_id, dot / norm / (SELECT norm FROM norms WHERE doc_id = 1) AS score FROM dots JOIN norms USING (doc_id))"""


@query("R7 P12", _content_sql() + " SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 10) DESC, doc_id LIMIT 10")
def similar_documents(spark, folder):
    docs = parquet_table(spark, folder, "documents")
    return content.similar_texts(docs, "doc_id", "text", 1).withColumn("score", F.round("score", 6))


@query("R7", _content_sql() + " SELECT doc_id, round(score, 6) AS score FROM scored")
def document_similarities(spark, folder):
    docs = parquet_table(spark, folder, "documents")
    return content.similar_texts(docs, "doc_id", "text", 1, count=None).withColumn("score", F.round("score", 6))
