"""Clean-up of landed film records with nested, printed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import joined_names, parsed_timestamp

# The columns kept, and those holding printed lists of records.
KEPT_COLUMNS = (
    "id", "title", "genres", "belongs_to_collection", "vote_average", "vote_count", "budget", "revenue", "popularity",
    "production_companies", "production_countries", "release_date", "runtime", "spoken_languages",
)
NESTED_COLUMNS = ("belongs_to_collection", "production_companies", "production_countries", "spoken_languages", "genres")
NO_COLLECTION = "[{'name':'No'}]"


def clean_records(records: DataFrame) -> DataFrame:
    """Records not marked adult, with nested names joined and the release date as a timestamp.

    ``unreadable`` counts nested fields that were present but could not be read.
    """
    kept = records.filter(F.col("adult").cast("boolean") == F.lit(False)).select(*KEPT_COLUMNS)
    kept = kept.withColumn("belongs_to_collection", F.coalesce("belongs_to_collection", F.lit(NO_COLLECTION)))
    names = {c: joined_names(F.col(c)) for c in NESTED_COLUMNS}
    failed = F.lit(0)
    for c in NESTED_COLUMNS:
        failed = failed + (F.col(c).isNotNull() & names[c].isNull()).cast("int")
    return (
        kept.withColumn("unreadable", failed)
        .withColumns(names)
        .withColumn("release_date", parsed_timestamp(F.col("release_date")))
    )


def sorted_by_id(records: DataFrame) -> DataFrame:
    return records.orderBy("id")
