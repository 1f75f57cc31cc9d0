"""Passages of more than fifty words against a plain search for equal windows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexivane.llm import passages, suffix


def documents(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = [[rng.choice(words) for _ in range(rng.choice([0, 10, 50, 51, 80, 200, 400]))] for _ in range(150)]
    for n in [30, 48, 50, 51, 51, 52, 60, 90, 120, 51]:
        a, b = rng.sample([i for i, d in enumerate(docs) if len(d) >= 200], 2)
        i, j = rng.randrange(len(docs[a]) - n), rng.randrange(len(docs[b]) - n)
        docs[b][j : j + n] = docs[a][i : i + n]
    docs += [docs[20], docs[20], ["same"] * 300, ["same"] * 40]
    return [rng.choice([" ", "  ", "\n"]).join(d) for d in docs] + [None, ""]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_are_those_of_a_plain_search(spark, seed):
    texts, windows = documents(seed), {}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for at in range(len(words) - 50):
            windows.setdefault(tuple(words[at : at + 51]), set()).add(i)
    expected = {i for rows in windows.values() if len(rows) > 1 for i in rows}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = [r.k for r in passages.passage_keys(df.repartition(3)).collect()]
    held = df.withColumn("k", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    assert {r.doc_id for r in held if r.k in keys} == expected and len(expected) >= 8
    assert len(keys) == len(set(keys))
    assert {r.doc_id for r in suffix.dedup_substrings(df).collect() if r.shares_passage} == expected


def test_no_rows_no_passages(spark):
    df = spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")
    assert passages.passage_keys(df).count() == 0 and passages.passage_keys(df.limit(0)).count() == 0
