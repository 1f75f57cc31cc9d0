"""CSV records put together from splits, against Spark's own multi-line reader."""

import random

import pytest

from lexivane.schemas import RECIPE
from lexivane.sources.recipes import CSV_OPTIONS, read_recipes, write_recipes
from lexivane.sources.records import csv_records

FIELDS = ["", "a", "b c", "x,y", 'say "hi"', "two\nlines", "\n", '"', 'end"', "crlf\r\nhere", " spaces ", "é\n,\"\n", "q" * 300, "l\n" * 200]


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = {f.name: rng.choice(FIELDS) or None for f in RECIPE.fields if f.dataType.simpleString() == "string"}
        out.append({**text, "name": f"row {i}", "rating_value": rng.choice([None, 1.5, -2.0]), "rating_count": rng.choice([None, 7])})
    return out


@pytest.mark.parametrize("split_bytes,files", [(500, 1), (4096, 3), (1 << 27, 2)])
def test_split_reader_equals_the_single_task_reader(spark, tmp_path, split_bytes, files):
    df = spark.createDataFrame(rows(300, files), RECIPE)
    write_recipes(df.coalesce(files), str(tmp_path / "csv"), "csv")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(split_bytes))
        split = read_recipes(spark, str(tmp_path / "csv"), split=True)
        if split_bytes == 500:
            assert csv_records(spark, str(tmp_path / "csv")).count() == 301  # with the header
            assert spark.read.text(str(tmp_path / "csv")).rdd.getNumPartitions() > 50
        got = sorted(map(str, split.collect()))
    finally:
        spark.conf.set(key, before)
    assert got == sorted(map(str, read_recipes(spark, str(tmp_path / "csv")).collect()))
    assert len(got) == 300


def test_records_without_a_last_line_break(spark, tmp_path):
    for name, text, expected in [
        ("a", 'h1,h2\n1,"x\ny"', ["h1,h2", '1,"x\ny"']),
        ("b", "h1,h2\r\n1,2\r\n\r\n3,4\r\n", ["h1,h2", "1,2", "3,4"]),
        ("c", "", []),
        ("d", 'h\n"never closed\n1\n2', ["h", '"never closed\n1\n2']),
    ]:
        path = tmp_path / f"{name}.csv"
        path.write_bytes(text.encode())
        got = csv_records(spark, str(path)).collect()
        assert sorted(r.text for r in got) == sorted(expected)
        assert [r.text for r in got if r.first] == expected[:1]


def test_options_are_those_of_the_reader():
    assert CSV_OPTIONS["escape"] == '"'  # a doubled quote: what the records rely on


def test_only_the_writing_of_one_file_runs_in_one_task(spark, sf, monkeypatch):
    """The join before it must not be drawn into the writer's single task."""
    import __spark_entry__ as entry
    from planview import plan_of

    class Stop(Exception):
        pass

    def caught(df, *args, **kwargs):
        assert "Coalesce 1" not in plan_of(df) and "SinglePartition" in plan_of(df)
        raise Stop

    monkeypatch.setattr(entry, "write_recipes", caught)
    try:
        entry.csv_split(spark, sf)
    except Stop:
        return
    raise AssertionError("nothing was written")
