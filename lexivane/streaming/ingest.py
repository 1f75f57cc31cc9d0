"""Incremental ingest of page files and streaming categorisation.

The extraction and tagging operators hold no state, so they are used unchanged; only
the set of URLs seen so far is state.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexivane.functions.taxonomy import RECIPES, Taxonomy
from lexivane.operators.categorize import categorize
from lexivane.operators.extract import RECIPE_PREFIX, RECIPE_TYPE, extract_jsonld, extract_links, flatten_recipe
from lexivane.schemas import PAGE

_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_pages(
    spark: SparkSession,
    path: str,
    schema: T.StructType = PAGE,
    max_files_per_trigger: int | None = None,
    names: str | None = None,
) -> DataFrame:
    """Page files as they arrive in the folder ``path``, or those whose name matches ``names``."""
    reader = spark.readStream.schema(schema)
    if names:
        reader = reader.option("pathGlobFilter", names)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def thin(df: DataFrame, key: str) -> DataFrame:
    """Drop repeats of a key inside each Arrow batch, without moving rows.

    Streaming deduplication has no map-side step: every row travels to the state of its
    key. A URL found on a third of all pages would overload one task; after this it
    arrives once per batch of thousands. NULL keys are kept as one key.
    """

    def first_of_each(batches):
        for batch in batches:
            if batch.num_rows:
                rows = pa.table({"k": batch.column(key), "at": pa.array(range(batch.num_rows), pa.int64())})
                first = rows.group_by("k").aggregate([("at", "min")])["at_min"].combine_chunks()
                yield batch.take(first.take(pc.sort_indices(first)))

    return df.mapInArrow(first_of_each, df.schema)


def deduplicate(df: DataFrame, key: str = "url", event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Keep the first row of each key.

    With an event time the state is bounded: keys older than ``delay`` behind the newest
    row are forgotten. Without one all keys are remembered.
    """
    if event_time is None:
        return thin(df, key).dropDuplicates([key])
    return thin(df, key).withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def link_stream(
    pages: DataFrame, prefix: str = RECIPE_PREFIX, base: str | None = None,
    event_time: str | None = None, delay: str | None = None,
) -> DataFrame:
    """Distinct links of a stream of pages."""
    keep = () if event_time is None else (event_time,)
    return deduplicate(extract_links(pages, prefix, base, keep=keep, distinct_in_page=True), "url", event_time, delay)


def recipe_stream(
    pages: DataFrame, type_: str = RECIPE_TYPE, event_time: str | None = None, delay: str | None = None
) -> DataFrame:
    """Flat recipes of a stream of pages, one per page URL; event time as for links."""
    keep = () if event_time is None else (event_time,)
    return deduplicate(flatten_recipe(extract_jsonld(pages, type_), keep=keep), "url", event_time, delay)


def stream_categorize(
    rows: DataFrame, taxonomy: Taxonomy = RECIPES, name: str = "name", ingredients: str = "ingredients",
    instructions: str = "instructions", out: str = "categories",
) -> DataFrame:
    """Tag a stream of recipes: the batch operator, which needs no state."""
    return categorize(rows, taxonomy, name, ingredients, instructions, out)


def run_available(rows: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process what has arrived, append it to ``out_path`` and stop.

    A later call with the same checkpoint goes on where this one ended. The state of
    seen keys grows with them, so it is kept in RocksDB, on disk, unless the session
    names another store. The session's own settings are as before afterwards.
    """
    spark = rows.sparkSession
    unset = spark.conf.get(_PROVIDER_KEY, None) is None
    if unset:
        spark.conf.set(_PROVIDER_KEY, _ROCKSDB)
    try:
        query = (
            rows.writeStream.format("parquet")
            .option("path", out_path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if unset:
            spark.conf.unset(_PROVIDER_KEY)


def ingest_stream(
    spark: SparkSession, path: str, out_path: str, checkpoint: str, what: str = "links",
    schema: T.StructType = PAGE, max_files_per_trigger: int | None = None, names: str | None = None, **options,
) -> DataFrame:
    """Ingest new page files into a table of links or recipes and return that table."""
    pages = stream_pages(spark, path, schema, max_files_per_trigger, names)
    rows = {"links": link_stream, "recipes": recipe_stream}[what](pages, **options)
    run_available(rows, out_path, checkpoint)
    return spark.read.schema(rows.schema).parquet(out_path)
