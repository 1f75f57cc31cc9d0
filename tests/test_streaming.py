from pyspark.sql import functions as F

from lexivane.operators.categorize import categorize
from lexivane.operators.extract import dedup_urls, extract_jsonld, extract_links, flatten_recipe
from lexivane.streaming.ingest import deduplicate, ingest_stream, link_stream, recipe_stream, run_available, stream_categorize, stream_pages, thin

BODY = '<script type="application/ld+json">{"@type":"Recipe","name":"r%d"}</script>'


def test_links_arrive_once_over_two_runs(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    pages.filter("page_id % 2 = 0").write.parquet(source)
    first = ingest_stream(spark, source, out, mark, prefix="/", base="https://h").count()
    pages.filter("page_id % 2 = 1").write.mode("append").parquet(source)
    links = ingest_stream(spark, source, out, mark, prefix="/", base="https://h")
    batch = dedup_urls(extract_links(pages, "/", "https://h"))
    assert first < links.count() == links.distinct().count()
    assert links.exceptAll(batch).isEmpty() and batch.exceptAll(links).isEmpty()
    assert ingest_stream(spark, source, out, mark, prefix="/", base="https://h").count() == batch.count()
    assert list((tmp_path / "mark" / "state").rglob("*.zip")), "seen URLs are kept in RocksDB"


def test_recipes_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"http://p/{i // 2}", BODY % (i // 2)) for i in range(20)] + [(99, "http://none", "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    pages.repartition(4).write.parquet(source)
    got = ingest_stream(spark, source, out, mark, "recipes", max_files_per_trigger=1)
    batch = flatten_recipe(extract_jsonld(pages)).distinct()
    assert got.exceptAll(batch).isEmpty() and got.count() == batch.count() == 10


def test_thin_keeps_one_per_key_and_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), (None, 5)], "url string, n int").coalesce(1)
    assert [tuple(r) for r in thin(df, "url").collect()] == [("a", 1), ("b", 2), (None, 4)]


def test_event_time_bounds_the_state(spark, tmp_path):
    rows = [(1, "http://p", '<a href="/x"><a href="/y">', "2024-01-01 00:00:00"), (2, "http://p", '<a href="/x">', "2024-01-01 00:05:00")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, ts string").withColumn("ts", F.to_timestamp("ts"))
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    pages.coalesce(1).write.parquet(source)
    stream = stream_pages(spark, source, pages.schema)
    run_available(link_stream(stream, "/", "https://h", event_time="ts", delay="1 hour"), out, mark)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["https://h/x", "https://h/y"]


def test_streaming_categories_equal_batch(spark, tmp_path):
    rows = [(i, n, g, "") for i, (n, g) in enumerate([("bolo", "mel"), ("frango", None), ("x", "y")])]
    df = spark.createDataFrame(rows, "id long, name string, ingredients string, instructions string")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    df.write.parquet(source)
    run_available(stream_categorize(stream_pages(spark, source, df.schema)), out, mark)
    assert sorted(spark.read.parquet(out).collect()) == sorted(categorize(df).collect())


def test_recipes_with_event_time_equal_batch(spark, tmp_path):
    rows = [(i, f"http://p/{i // 2}", BODY % (i // 2), f"2024-01-01 00:{59 - i:02d}:00") for i in range(20)]  # late ones too
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, ts string").withColumn("ts", F.to_timestamp("ts"))
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    pages.repartition(4).write.parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    stream = stream_pages(spark, source, pages.schema, max_files_per_trigger=1)
    run_available(recipe_stream(stream, event_time="ts", delay="2 hours"), out, mark)
    got = spark.read.parquet(out).drop("ts")
    batch = flatten_recipe(extract_jsonld(pages)).distinct()
    assert got.exceptAll(batch).isEmpty() and got.count() == batch.count() == 10
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
