"""Where lineage is cut, and that task code travels with its closure."""

import os
import subprocess
import sys

from ledgerlens.session import checkpoint_root, materialized, small_side

CONFIGURED = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", {folder!r}).config("spark.ui.enabled", "false").getOrCreate())
from ledgerlens.session import materialized
from ledgerlens.plans import probabilistic as P
from pyspark.sql import functions as F
df = materialized(spark.range(5).select(F.col("id").alias("x"), F.lit(1.0).alias("tx"), F.lit(2.0).alias("T")))
model = P.PurchaseModel(2.0, 10.0, 0.2, 2.5)
print(df.select(P.expected_purchases(model, 4, F.col("x"), F.col("tx"), F.col("T")).alias("e")).filter("e > 0").count())
"""


def test_configured_folder_is_used_and_tasks_need_no_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = CONFIGURED.format(repo=repo, folder=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, timeout=180)
    assert done.stdout.strip().endswith("5"), done.stderr[-2000:]
    assert any(p.name.startswith("stage-") for p in (tmp_path / "shared").rglob("stage-*"))


def test_materialized_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "a long, v array<double>")
    written = materialized(df)
    assert written.schema == df.schema and sorted(r["a"] for r in written.collect()) == [1, 2]
    assert checkpoint_root(spark)


def test_small_side_hint_depends_on_size(spark):
    df = spark.range(10)
    assert "ResolvedHint" in small_side(df, 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in small_side(df, 9)._jdf.queryExecution().analyzed().toString()
