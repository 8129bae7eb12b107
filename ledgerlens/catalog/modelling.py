"""Clustering, model fitting and evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, NaiveBayes
from pyspark.ml.feature import Binarizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ledgerlens.catalog import sql as S
from ledgerlens.catalog.registry import query, single
from ledgerlens.functions.exprs import FOLD_FACTOR, SPLIT_FACTOR
from ledgerlens.models import boost, clusters, evaluate, moments, newton, search
from ledgerlens.models.cells import candidate_splits, cell_table
from ledgerlens.session import at_once, reused, scratch_path
from ledgerlens.sources import views
from ledgerlens.sources.tables import parquet_table

SERVICES = ("backup", "support", "streaming", "plan")
THRESHOLD = 0.05

_TOLD = f"{S.SCORED}, told AS (SELECT label, CAST(score > {THRESHOLD} AS INT) AS prediction, score FROM scored)"


def _told(spark, folder):
    return views.scored_events(spark, folder).withColumn("prediction", (F.col("score") > THRESHOLD).cast("int"))


@query("L22", f"WITH {_TOLD} SELECT CAST(label AS DOUBLE) AS label, CAST(prediction AS DOUBLE) AS prediction, count(*) AS count FROM told GROUP BY ALL")
def confusion_matrix(spark, folder):
    return evaluate.confusion(_told(spark, folder))


_CLASSES = f"""{_TOLD},
per AS (SELECT c, count(*) FILTER (label = c AND prediction = c) AS hits, count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS predicted
        FROM told, (VALUES (0), (1)) v(c) GROUP BY c),
m AS (SELECT c, hits / predicted AS precision, hits / support AS recall, 2.0 * hits / (predicted + support) AS f1, support, hits FROM per)"""


@query(
    "L22",
    f"""WITH {_CLASSES}, r AS (SELECT CAST(c AS VARCHAR) AS name, precision, recall, f1, support FROM m
    UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), CAST(sum(support) AS BIGINT) FROM m
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM m
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
                     CAST(sum(support) AS BIGINT) FROM m)
    SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r""",
)
def classification_report(spark, folder):
    report = evaluate.classification_report(evaluate.confusion(_told(spark, folder)))
    return report.select("name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "L23",
    f"""WITH {S.SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY score)
    SELECT round(score, 8) AS threshold, round(sum(neg) OVER (ORDER BY score DESC) / (SELECT sum(neg) FROM g), 8) AS fpr,
           round(sum(pos) OVER (ORDER BY score DESC) / (SELECT sum(pos) FROM g), 8) AS tpr FROM g
    UNION ALL SELECT round(max(score) + 1, 8), 0, 0 FROM g""",
)
def roc_curve(spark, folder):
    points = evaluate.roc_points(views.scored_events(spark, folder))
    return points.select(*[F.round(c, 8).alias(c) for c in ("threshold", "fpr", "tpr")])


@query(
    "L23",
    f"""WITH {S.SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) AS low, count(*) OVER (PARTITION BY score) AS same FROM scored),
    s AS (SELECT sum(low + (same - 1) / 2.0) FILTER (label = 1) AS ranks, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS p,
                 CAST(count(*) FILTER (label = 0) AS DOUBLE) AS n FROM r)
    SELECT round((ranks - p * (p + 1) / 2) / (p * n), 8) AS auc FROM s""",
)
def roc_area(spark, folder):
    return evaluate.roc_area(views.scored_events(spark, folder)).withColumn("auc", F.round("auc", 8))


_PRICED = """priced AS (SELECT l_extendedprice * (1 - l_discount) * (1 + l_tax) AS label, l_extendedprice * (1 - l_discount) AS prediction FROM lineitem)"""


@query(
    "L25",
    f"""WITH {_PRICED} SELECT round(1 - avg((label - prediction) * (label - prediction)) / var_pop(label), 8) AS r2,
    {S.single('avg(abs(label - prediction))')} AS mae, {S.single('avg((label - prediction) * (label - prediction))')} AS mse,
    {S.single('sqrt(avg((label - prediction) * (label - prediction)))')} AS rmse FROM priced""",
)
def regression_errors(spark, folder):
    lines = views.priced_lines(spark, folder).withColumn("prediction", F.col("extended") * (1 - F.col("discount")))
    found = evaluate.regression_errors(lines)
    return found.select(F.round("r2", 8).alias("r2"), *[single(F.col(c)).alias(c) for c in ("mae", "mse", "rmse")])


@query("L7")
def kmeans_clusters(spark, folder):
    from ledgerlens.catalog.neighbours import _standardised

    rows = reused(clusters.with_vector(_standardised(spark, folder), ["recency", "frequency", "monetary"]))
    return clusters.fit_kmeans(rows, 3).transform(rows).groupBy("cluster").agg(F.count(F.lit(1)).alias("customers"), F.avg("recency").alias("recency"))


def _elbow_sql() -> str:
    scaled = f"""{S.CLEAN}, {S.rfm('clean').replace('sum(quantity * price) AS', 'round(sum(quantity * price), 2) AS')},
    long AS (SELECT unnest(['recency', 'frequency', 'monetary']) AS "column", unnest([
      (recency - (SELECT min(recency) FROM rfm)) / (SELECT CAST(max(recency) - min(recency) AS DOUBLE) FROM rfm),
      (frequency - (SELECT min(frequency) FROM rfm)) / (SELECT CAST(max(frequency) - min(frequency) AS DOUBLE) FROM rfm),
      (monetary - (SELECT min(monetary) FROM rfm)) / (SELECT CAST(max(monetary) - min(monetary) AS DOUBLE) FROM rfm)]) AS v FROM rfm)"""
    return f"""WITH RECURSIVE {scaled},
    centred AS (SELECT "column", v - avg(v) OVER (PARTITION BY "column") AS v FROM long),
    grouped AS (SELECT "column", v, count(*) AS n FROM centred GROUP BY ALL),
    upto AS (SELECT "column", row_number() OVER w AS i, CAST(sum(n) OVER w AS DOUBLE) AS n, sum(n * v) OVER w AS s, sum(n * v * v) OVER w AS q
             FROM grouped WINDOW w AS (PARTITION BY "column" ORDER BY v)),
    runs AS (SELECT b."column", a.i AS start, b.i AS stop, (b.q - a.q) - (b.s - a.s) * (b.s - a.s) / (b.n - a.n) AS cost
             FROM (SELECT "column", i, n, s, q FROM upto UNION ALL SELECT DISTINCT "column", 0, 0.0, 0.0, 0.0 FROM upto) a JOIN upto b ON a."column" = b."column" AND a.i < b.i),
    best AS (SELECT "column", 1 AS k, stop, cost FROM runs WHERE start = 0
             UNION ALL SELECT r."column", p.k + 1, r.stop, min(p.cost + r.cost) FROM best p JOIN runs r ON r."column" = p."column" AND r.start = p.stop
             WHERE p.k < 19 GROUP BY r."column", p.k, r.stop),
    costs AS (SELECT "column", k, greatest(arg_max(cost, stop), 0) AS cost FROM best JOIN (SELECT "column", max(i) AS stop FROM upto GROUP BY ALL) USING ("column", stop) GROUP BY ALL),
    drops AS (SELECT *, first_value(cost) OVER w + (last_value(cost) OVER w - first_value(cost) OVER w) * (k - 1) / greatest(max(k) OVER w - 1, 1) - cost AS fall
              FROM costs WINDOW w AS (PARTITION BY "column" ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT "column", CAST(k AS INT) AS k, round(cost, 6) AS cost, row_number() OVER (PARTITION BY "column" ORDER BY round(fall, 9) DESC, k) = 1 AS chosen FROM drops"""


@query("L7", _elbow_sql())
def kmeans_elbow(spark, folder):
    """Least costs of 1 to 19 clusters of each measure, and where the curve bends most."""
    from ledgerlens.catalog.neighbours import _standardised

    rows = reused(_standardised(spark, folder))
    found = []
    for column in ("recency", "frequency", "monetary"):
        costs = clusters.kmeans_costs(rows, [column])
        chosen = clusters.knee(costs)
        found += [(column, k, round(c, 6), k == chosen) for k, c in costs]
    rows.unpersist()
    return spark.createDataFrame(found, "column string, k int, cost double, chosen boolean")


@query("L8")
def kmodes_clusters(spark, folder):
    return clusters.kmodes_clusters(views.service_table(spark, folder), SERVICES, 3)


@query("L8")
def kmodes_elbow(spark, folder):
    costs = clusters.kmodes_costs(views.service_table(spark, folder), SERVICES)
    return spark.createDataFrame(costs, "k int, cost long")


@query(
    "L6",
    f"""SELECT CASE WHEN {S.key_spot('doc_id', 123, SPLIT_FACTOR)} < 0.20 THEN 'test' ELSE 'train' END AS part, CAST(quality AS DOUBLE) AS label,
    count(*) AS documents FROM documents JOIN labels USING (doc_id) GROUP BY ALL""",
)
def train_test_sizes(spark, folder):
    train, test = search.train_test_split(views.classified_documents(spark, folder), "doc_id", 0.20, 123)
    sizes = [d.groupBy("label").agg(F.count(F.lit(1)).alias("documents")).select(F.lit(n).alias("part"), "label", "documents") for n, d in (("train", train), ("test", test))]
    return sizes[0].unionByName(sizes[1])


def _documents(spark, folder):
    """Labelled documents split 80/20, with a feature vector whose scales and codes come from the training part."""
    parts = search.train_test_split(views.classified_documents(spark, folder), "doc_id", 0.20, 123)
    prepared = Pipeline(stages=search.feature_stages(["n_chars", "toxic"], ["lang", "source"])).fit(parts[0])
    return [reused(prepared.transform(part).select("doc_id", "features", "label")) for part in parts]


@query("L14 L15 L13 L16 L17 L21")
def model_sweep(spark, folder):
    train, test = _documents(spark, folder)
    return search.model_sweep(train, test, search.classifiers(4, key="doc_id"), "doc_id")


@query("L17 L22 L23")
def model_reports(spark, folder):
    """Report rows of every model of the sweep, its confusion counts and area, all from one table of predictions."""
    train, test = _documents(spark, folder)
    told = reused(search.held_out_predictions(train, test, search.classifiers(4, key="doc_id"), "doc_id"))
    report = evaluate.classification_report(evaluate.confusion(told, by=["model"]), ["model"])
    areas = evaluate.roc_ladders(told).groupBy("model").agg(F.max("auc").alias("auc"))
    return report.join(areas, "model")


#: Training documents with codes, folds, candidate thresholds and, for every fold and threshold, class counts of both sides.
_SPLITS = f"""raw AS (
  SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(toxic AS DOUBLE) AS toxic, lang, source, CAST(quality AS DOUBLE) AS label,
         CAST(floor({S.key_spot('doc_id', 42, FOLD_FACTOR)} * 5) AS INT) AS fold
  FROM documents JOIN labels USING (doc_id) WHERE NOT ({S.key_spot('doc_id', 123, SPLIT_FACTOR)} < 0.20)),
coded AS (SELECT *, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS DOUBLE) AS lang_code, CAST(dense_rank() OVER (ORDER BY source) - 1 AS DOUBLE) AS source_code FROM raw),
long AS (SELECT doc_id, fold, label, unnest([0, 1, 2, 3]) AS feature, unnest([n_chars, toxic, lang_code, source_code]) AS value FROM coded),
kinds AS (SELECT feature, count(DISTINCT value) AS n FROM long GROUP BY feature),
edges AS (
  SELECT feature, (value + after) / 2 AS threshold
  FROM (SELECT feature, value, lead(value) OVER (PARTITION BY feature ORDER BY value) AS after FROM (SELECT DISTINCT feature, value FROM long)) JOIN kinds USING (feature)
  WHERE n <= 32 AND after IS NOT NULL
  UNION SELECT feature, unnest(q) FROM (
    SELECT feature, quantile_cont(value, [{', '.join(f'{k / 32}' for k in range(1, 32))}]) AS q FROM long JOIN kinds USING (feature) WHERE n > 32 GROUP BY feature)),
sides AS (
  SELECT f.fold, e.feature, e.threshold,
         CAST(count(*) FILTER (value <= threshold AND label = 0) AS DOUBLE) AS l0, CAST(count(*) FILTER (value <= threshold AND label = 1) AS DOUBLE) AS l1,
         CAST(count(*) FILTER (value > threshold AND label = 0) AS DOUBLE) AS r0, CAST(count(*) FILTER (value > threshold AND label = 1) AS DOUBLE) AS r1
  FROM (SELECT unnest(range(5)) AS fold) f, edges e JOIN long USING (feature) WHERE long.fold <> f.fold GROUP BY ALL)"""

_BAYES = """long_bits AS (
  SELECT doc_id, fold, label, feature, value > avg(value) OVER (PARTITION BY feature) AS b FROM long),
smoothings AS (SELECT unnest([0.1, 0.5, 1.0, 1.5, 2.0]) AS s),
folds AS (SELECT DISTINCT fold AS k FROM coded),
classes AS (SELECT k, label, count(*) AS n FROM coded, folds WHERE fold <> k GROUP BY ALL),
priors AS (SELECT k, label, s, n, ln((n + s) / (sum(n) OVER (PARTITION BY k, s) + 2 * s)) AS prior FROM classes, smoothings),
rates AS (SELECT k, label, feature, count(*) FILTER (b) AS hits FROM long_bits, folds WHERE fold <> k GROUP BY ALL),
points AS (SELECT d.doc_id, d.fold, d.label AS truth, p.label AS class, p.s, any_value(prior)
             + sum(CASE WHEN b THEN ln((hits + s) / (n + 2 * s)) ELSE ln(1 - (hits + s) / (n + 2 * s)) END) AS score
           FROM long_bits d JOIN priors p ON p.k = d.fold JOIN rates r ON r.k = d.fold AND r.label = p.label AND r.feature = d.feature
           GROUP BY d.doc_id, d.fold, d.label, p.label, p.s),
told AS (SELECT doc_id, fold, truth, s, CASE WHEN max(score) FILTER (class = 1) > max(score) FILTER (class = 0) THEN 1 ELSE 0 END AS guess FROM points GROUP BY ALL),
f1s AS (SELECT fold, s, coalesce(2.0 * count(*) FILTER (guess = 1 AND truth = 1) / nullif(count(*) FILTER (guess = 1) + count(*) FILTER (truth = 1), 0), 0) AS f1 FROM told GROUP BY ALL)"""


@query("L15 L19", f"WITH {_SPLITS}, {_BAYES} SELECT 'smoothing=' || CAST(s AS DECIMAL(2, 1)) AS parameters, round(avg(f1), 8) AS f1 FROM f1s GROUP BY s")
def bayes_grid_search(spark, folder):
    train, _ = _documents(spark, folder)
    bayes = NaiveBayes(modelType="bernoulli", featuresCol="binary")
    estimator = Pipeline(stages=[Binarizer(threshold=0.0, inputCol="features", outputCol="binary"), bayes])
    found = search.grid_search(estimator, search.parameter_grid({bayes.smoothing: [0.1, 0.5, 1.0, 1.5, 2.0]}), train, "doc_id")
    return search.grid_results(found, spark).withColumn("f1", F.round("f1", 8))


@query("L14 L19")
def boosting_grid_search(spark, folder):
    train, _ = _documents(spark, folder)
    return search.boosting_grid([25, 50, 75, 100, 200], [0.1, 0.5, 1.0, 1.2, 1.5], ["SAMME", "SAMME.R"], train, "doc_id")


@query("L13 L19")
def boosted_tree_grid_search(spark, folder):
    train, _ = _documents(spark, folder)
    return search.newton_grid([25, 50, 75, 100, 200], [0.1, 0.5, 1.0, 1.2, 1.5], [1, 2, 3, 4, 5], train, "doc_id")


def _raw_features(spark, folder):
    """Training documents with unscaled features, as the first rounds are compared with SQL."""
    train, _ = search.train_test_split(views.classified_documents(spark, folder), "doc_id", 0.20, 123)
    prepared = Pipeline(stages=search.feature_stages(["n_chars", "toxic"], ["lang", "source"], scale=False)).fit(train)
    return reused(prepared.transform(train).select("doc_id", vector_to_array("features").alias("x"), "label"))


@query(
    "L14",
    f"""WITH {_SPLITS}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(2 * l0 * l1 / (l0 + l1) + 2 * r0 * r1 / (r0 + r1), 6), feature, threshold) AS place
      FROM sides WHERE l0 + l1 > 0 AND r0 + r1 > 0)
    SELECT CAST(fold AS INT) AS fold, CAST(feature AS INT) AS feature, round(threshold, 6) AS threshold,
           round(ln(greatest(l1 / (l0 + l1), 2.220446049250313e-16)) - ln(greatest(l0 / (l0 + l1), 2.220446049250313e-16)), 6) AS "left",
           round(ln(greatest(r1 / (r0 + r1), 2.220446049250313e-16)) - ln(greatest(r0 / (r0 + r1), 2.220446049250313e-16)), 6) AS "right"
    FROM ranked WHERE place = 1""",
)
def boosting_first_rounds(spark, folder):
    rows = _raw_features(spark, folder)
    splits = candidate_splits(rows, "x")
    plans = [boost.Plan(1.0, False, fold) for fold in range(5)]
    cells = cell_table(rows, "x", "label", search.fold_number("doc_id", 5, 42), splits, len(plans))
    stumps, _, _ = boost.boosted(cells, splits, plans, 1)
    found = [(fold, s.feature, s.threshold, s.left, s.right) for fold, made in enumerate(stumps) for s in made]
    told = spark.createDataFrame(found, "fold int, feature int, threshold double, left double, right double")
    return told.select("fold", "feature", *[F.round(c, 6).alias(c) for c in ("threshold", "left", "right")])


@query(
    "L13",
    f"""WITH {_SPLITS},
    slopes AS (SELECT *, (l0 - l1) / 2 AS lg, (l0 + l1) / 4 AS lh, (r0 - r1) / 2 AS rg, (r0 + r1) / 4 AS rh FROM sides),
    gains AS (
      SELECT fold, feature, threshold, lg, lh, rg, rh, lg * lg / (lh + 1) + rg * rg / (rh + 1) - (lg + rg) * (lg + rg) / (lh + rh + 1) AS gain
      FROM slopes WHERE lh >= 1 AND rh >= 1
      UNION ALL SELECT DISTINCT fold, 0, CAST('Infinity' AS DOUBLE), lg + rg, lh + rh, lg + rg, lh + rh, 0.000001 FROM slopes),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(gain, 6) DESC, feature, threshold DESC) AS place FROM gains)
    SELECT CAST(fold AS INT) AS fold, CAST(feature AS INT) AS feature, round(threshold, 6) AS threshold,
           round(-0.3 * lg / (lh + 1), 6) AS "left", round(-0.3 * rg / (rh + 1), 6) AS "right" FROM ranked WHERE place = 1""",
)
def boosted_first_trees(spark, folder):
    rows = _raw_features(spark, folder)
    splits = candidate_splits(rows, "x")
    plans = [newton.Plan(0.3, 1, fold) for fold in range(5)]
    cells = cell_table(rows, "x", "label", search.fold_number("doc_id", 5, 42), splits, len(plans))
    trees, _ = newton.newton_boosted(cells, splits, plans, 1)
    found = [(fold, t.features[0][0], t.thresholds[0][0], *t.leaves) for fold, made in enumerate(trees) for t in made]
    told = spark.createDataFrame(found, "fold int, feature int, threshold double, left double, right double")
    return told.select("fold", "feature", *[F.round(c, 6).alias(c) for c in ("threshold", "left", "right")])


@query("L16 L19")
def margin_grid_search(spark, folder):
    train, _ = _documents(spark, folder)
    margin = LinearSVC(maxIter=50)
    grid = search.parameter_grid({margin.regParam: [0.1, 0.3, 0.5, 0.7, 1.0]})
    return search.grid_results(search.grid_search(margin, grid, train, "doc_id"), spark)


@query("L16 L18 L22")
def soft_vote_predictions(spark, folder):
    train, test = _documents(spark, folder)
    models = [
        boost.AdaBoostClassifier(rounds=50).fit(train),
        search.bernoulli_bayes().fit(train),
        search.CalibratedMargin(LinearSVC(maxIter=50), "doc_id").fit(train),
    ]
    told = search.SoftVote(models).transform(test)
    return told.select("doc_id", "label", "prediction")


@query("L18 L22")
def boosted_vote_report(spark, folder):
    """Report of the soft vote of naive Bayes, AdaBoost and second-order boosted trees, 50 rounds each."""
    train, test = _documents(spark, folder)
    candidates = [search.bernoulli_bayes(), boost.AdaBoostClassifier(rounds=50), newton.NewtonBoostClassifier(rounds=50, depth=3)]
    vote = search.SoftVote(at_once(spark, [lambda e=e: e.fit(train) for e in candidates]))
    return evaluate.classification_report(evaluate.confusion(vote.transform(test)))


@query("L24")
def learning_curve(spark, folder):
    train, _ = _documents(spark, folder)
    fractions = (0.1, 0.325, 0.55, 0.775, 1.0)
    found = search.boosting_curves(train, "doc_id", fractions, folds=5)
    others = {n: e for n, e in search.classifiers(4).items() if n not in {name for name, *_ in found}}
    found += evaluate.learning_curves(train, "doc_id", others, lambda d: evaluate.summary(d)["accuracy"], fractions, folds=5)
    return spark.createDataFrame(found, "model string, fraction double, train_score double, validation_score double")


def _prices(spark, folder):
    lines = views.priced_lines(spark, folder)
    return search.train_test_split(lines, "id", 0.30, 101)


@query("L9 L10 L11 L12 L13 L20 L21")
def price_cross_validation(spark, folder):
    train, _ = _prices(spark, folder)
    stages = search.feature_stages(["extended", "discount", "tax", "quantity"], ["flag"])
    return search.cross_validated_rmse(train, "id", search.regressors(key="id"), stages, folds=10)


@query("L9 L10 L28 L4")
def price_feature_sets(spark, folder):
    train, test = _prices(spark, folder)
    sets = {"all": (["extended", "discount", "tax", "quantity"], ["flag"]), "reduced": (["extended", "tax"], [])}
    return search.compare_feature_sets(train, test, sets, search.regressors(key="id"))


@query("L10 L11 L13 L25")
def price_model_errors(spark, folder):
    train, test = _prices(spark, folder)
    sets = {"all": (["extended", "discount", "tax", "quantity"], ["flag"])}
    return search.compare_feature_sets(train, test, sets, search.regressors(key="id"))


_RETURNS = """returns AS (
  SELECT l_quantity AS a, l_extendedprice / 1000 AS b, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem)"""


def _returned_lines(spark, folder):
    line = parquet_table(spark, folder, "lineitem")
    rows = line.select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (F.col("l_returnflag") == "R").cast("double").alias("label"))
    return reused(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows))


def _terms(spark, model):
    return spark.createDataFrame(list(zip(("constant", "quantity", "price"), (model.constant, *model.linear), strict=True)), "term string, value double")


@query(
    "L17",
    f"""WITH {_RETURNS},
    m AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0,
                 avg(a) FILTER (y = 1) AS a1, avg(b) FILTER (y = 1) AS b1, avg(a) FILTER (y = 0) AS a0, avg(b) FILTER (y = 0) AS b0,
                 (n1 * var_pop(a) FILTER (y = 1) + n0 * var_pop(a) FILTER (y = 0)) / (n1 + n0 - 2) AS saa,
                 (n1 * var_pop(b) FILTER (y = 1) + n0 * var_pop(b) FILTER (y = 0)) / (n1 + n0 - 2) AS sbb,
                 (n1 * covar_pop(a, b) FILTER (y = 1) + n0 * covar_pop(a, b) FILTER (y = 0)) / (n1 + n0 - 2) AS sab FROM returns),
    w AS (SELECT *, (sbb * (a1 - a0) - sab * (b1 - b0)) / (saa * sbb - sab * sab) AS wa, (saa * (b1 - b0) - sab * (a1 - a0)) / (saa * sbb - sab * sab) AS wb FROM m)
    SELECT 'constant' AS term, round(ln(n1 / n0) - (wa * (a1 + a0) + wb * (b1 + b0)) / 2, 8) AS value FROM w
    UNION ALL SELECT 'quantity', round(wa, 8) FROM w UNION ALL SELECT 'price', round(wb, 8) FROM w""",
)
def discriminant_coefficients(spark, folder):
    """Linear discriminant of returned lines: class means and pooled covariance from one aggregate."""
    model = moments.DiscriminantClassifier().fit(_returned_lines(spark, folder))
    return _terms(spark, model).withColumn("value", F.round("value", 8))


@query(
    "L17",
    f"""WITH {_RETURNS},
    m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(2 * y - 1) AS my, count(*) * var_pop(a) + 10 AS saa, count(*) * var_pop(b) + 10 AS sbb,
                 count(*) * covar_pop(a, b) AS sab, count(*) * covar_pop(a, 2 * y - 1) AS say, count(*) * covar_pop(b, 2 * y - 1) AS sby FROM returns),
    w AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS wa, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS wb FROM m)
    SELECT 'constant' AS term, round(my - wa * ma - wb * mb, 8) AS value FROM w
    UNION ALL SELECT 'quantity', round(wa, 8) FROM w UNION ALL SELECT 'price', round(wb, 8) FROM w""",
)
def ridge_coefficients(spark, folder):
    """Ridge classifier of returned lines with a penalty of 10."""
    model = moments.RidgeClassifier(penalties=[10.0]).fit(_returned_lines(spark, folder))
    return _terms(spark, model).withColumn("value", F.round("value", 8))


_FOLDED = """priced AS (
  SELECT l_extendedprice AS x, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS y, l_orderkey % 10 AS fold FROM lineitem)"""


@query(
    "L9 L20",
    f"""WITH {_FOLDED},
    fits AS (SELECT f.fold, regr_slope(y, x) AS slope, regr_intercept(y, x) AS start FROM priced p JOIN (SELECT DISTINCT fold FROM priced) f ON p.fold <> f.fold GROUP BY f.fold)
    SELECT p.fold, round(sqrt(avg((y - start - slope * x) * (y - start - slope * x))), 4) AS rmse FROM priced p JOIN fits USING (fold) GROUP BY p.fold""",
)
def linear_fold_errors(spark, folder):
    """Held-out error of the linear model of price on ten folds of whole orders, all from one pass."""
    line = parquet_table(spark, folder, "lineitem")
    y = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    errors = moments.linear_fold_errors(line, F.col("l_orderkey") % 10, F.array("l_extendedprice"), y)
    return spark.createDataFrame(list(errors.items()), "fold long, rmse double").withColumn("rmse", F.round("rmse", 4))


@query(
    "L20 L28",
    f"""WITH {_FOLDED}, t AS (SELECT fold, unnest([0, 0, 0, 1, 1, 2]) AS row_no, unnest([0, 1, 2, 1, 2, 2]) AS col_no,
           unnest([1.0, x, y, x * x, x * y, y * y]) AS v FROM priced)
    SELECT fold, row_no, col_no, round(sum(v) / 1000000, 3) AS millions FROM t GROUP BY ALL""",
)
def linear_fold_products(spark, folder):
    """The sums of products behind the folds: entries of (1, price, net price) crossed with itself, by fold."""
    line = parquet_table(spark, folder, "lineitem")
    y = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    sums = moments.product_sums(line, F.col("l_orderkey") % 10, F.array("l_extendedprice"), y)
    found = [(int(f), i, j, float(m[i, j]) / 1e6) for f, m in sums.items() for i in range(3) for j in range(i, 3)]
    return spark.createDataFrame(found, "fold long, row_no int, col_no int, millions double").withColumn("millions", F.round("millions", 3))


@query("S8 L26 L1")
def stored_model_estimates(spark, folder):
    train, test = _prices(spark, folder)
    model = Pipeline(stages=[*search.feature_stages(["extended", "discount", "tax"], ["flag"]), LinearRegression()]).fit(train)
    path = scratch_path(spark, "price-model")
    search.save_model(model, path)
    return search.scored(search.load_model(path), test).select("id", "label", "estimate")
