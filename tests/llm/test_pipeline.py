"""The whole pipeline on planted cases, stage by stage against plain versions; and operators on
texts with very many matches, rare languages and many small files."""

import random
import re

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexivane.llm import langid, packing, pii, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < 5:
        return {(len(words), *words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ","]) for _ in range(n))

    items = [prose(rng.choice([8, 15, 40])) for _ in range(12)] + [None, ""]
    texts = [prose(rng.choice([60, 120, 300])) for _ in range(60)]
    texts += [texts[3], texts[3], texts[10]]  # copies
    for i in (5, 6, 7, 5):  # near copies
        words = texts[i].split(" ")
        words[10] = "changed"
        texts.append(" ".join(words))
    for i in range(6):
        texts.append(prose(50) + " " + items[i] + " " + prose(40))
    texts += [prose(60) + " write to some.one@example.org or 10.1.2.3 " + prose(5), prose(70) + " call +49 (30) 123-4567 now"]
    texts += [prose(20), "junk " * 200, "# * $ " * 100, None, "", prose(12_000)]
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict(enumerate(texts)), items


def components(ids, linked):
    label = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return label


def test_stages_keep_what_plain_versions_keep(spark, folder):
    path, texts, items = folder
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op10_quality_rules']}) WHERE kept").fetchall()}
    sets = {i: shingles(texts[i]) for i in good}
    label = components(sorted(good), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    one = {i for i in good if label[i] == i}
    tests = [s for s in map(shingles, items) if s]
    clean = {i for i in one if not any(5 * len(s & sets[i]) >= 4 * len(s) for s in tests)}
    expected = [good, one, clean, clean]
    assert len(texts) > len(good) > len(one) > len(clean) > 30

    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    for (name, stage), keep in zip(corpus_pipeline.STAGES[:4], expected):
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} == keep, name
    masked = {r.doc_id: r for r in docs.collect()}
    marks = 0
    for i in clean:
        text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[EMAIL]", texts[i])
        text = text.replace("10.1.2.3", "[IP]").replace("+49 (30) 123-4567", "[PHONE]")
        marks += text != texts[i]
        assert masked[i].text == text and masked[i].n_chars == len(text)
    assert marks == 2

    pieces = corpus_pipeline.run(spark, path).collect()
    library = Tokenizer.from_file(PATH)
    by_doc, bins = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    assert set(by_doc) == clean
    for i, rows in by_doc.items():
        rows.sort(key=lambda r: r.piece)
        assert sum(r.n_tokens for r in rows) == len(library.encode(masked[i].text, add_special_tokens=False).ids)
        assert [r.first_token for r in rows] == [4096 * n for n in range(len(rows))] and all(r.n_tokens == 4096 for r in rows[:-1])
    for rows in bins.values():
        rows.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
        used, length = sum(r.n_tokens for r in rows), rows[0].bin_length
        assert length == min(x for x in packing.LENGTHS if x >= used)


# --- 9 ---------------------------------------------------------------------------------


def test_bins_do_not_depend_on_the_files(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, "word " * rng.randint(1, 3000)) for i in range(600)], "doc_id long, text string")
    columns = ["doc_id", "piece", "n_tokens", "bin_id", "bin_offset", "bin_length"]
    few, many = (
        sorted(packing.pack_documents(d, PATH, group_tokens=200_000).select(columns).collect()) for d in (df.coalesce(1), df.repartition(97))
    )
    assert few == many and len({r.bin_id >> 32 for r in few}) > 3
    filled = packing.summarise(packing.pack_documents(df.repartition(97), PATH)).collect()
    assert sum(r.n_tokens for r in filled) / sum(r.n_bins * r.bin_length for r in filled) > 0.95


# --- 8 ---------------------------------------------------------------------------------


def test_very_many_matches_in_one_text(spark):
    n = 4_000
    text = " ".join(f"a{i}@b.cd" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "x y@z.org.")], "doc_id long, text string")
    masked = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert masked == {1: " ".join(["[EMAIL]"] * n), 2: "x [EMAIL]."}
    found = {r.doc_id: r.n_email for r in pii.report(pii.scan(df).withColumn("extra", F.array().cast("array<struct<start:int,end:int,value:string,kind:string>>"))).collect()}
    assert found == {1: n, 2: 1}


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 256, 300])
def test_blocks_of_matches_join_up(spark, n):
    text = "\U0001f600" + "".join(f" é{i}@b.cd +1 (2) 34567890" for i in range(n)) + " end"
    row = pii.report(pii.find_pii(*(lambda s: (s, pii.learn_patterns(s)))(pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))))).first()
    emails = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+@b\.cd", text)]
    phones = [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+1 \(2\) 34567890", text)]
    assert set(emails + phones) <= set(row.spans.split(",")) | {""} and (row.n_email, row.n_phone) == (n, n)
    masked = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert masked == re.sub(r"\+1 \(2\) 34567890", "[PHONE]", re.sub(r"[0-9]+@b\.cd", "[EMAIL]", text))


def test_context_words_of_any_length(spark):
    long = "w" * 300
    df = spark.createDataFrame([(1, f"so {long} a@b.cd and then\n\nmail:  c@d.ef")], "doc_id long, text string")
    patterns = [c.patterns for c in pii.scan(df).first().candidates]
    assert patterns == [[long, f"so {long}"], ["mail:", "then mail:"]]


# --- 6 ---------------------------------------------------------------------------------


def test_features_and_frequencies_are_the_plain_ones(spark):
    texts = ["aba", "AB a", "", "é\U0001f600é", "x" * 5000 + "yz"]
    for text, (buckets, times) in zip(texts, langid.counts(pa.array(texts))):
        folded = "".join(c.lower() if c.isascii() else c for c in text)
        grams = [folded[i : i + n] for n in langid.GRAMS for i in range(len(folded) - n + 1)]
        assert times.sum() == len(grams) and len(buckets) <= len(set(grams))
        if text == "aba":  # a, b, ab, ba, aba
            assert sorted(times.tolist()) == [1, 1, 1, 1, 2]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    n, frequency = langid.document_frequencies(df.repartition(3), "text")
    plain = np.zeros(langid.BUCKETS, int)
    for buckets, _ in langid.counts(pa.array(texts)):
        plain[buckets] += 1
    assert n == len(texts) and (frequency == plain).all()


def test_prediction_is_the_plain_one(spark):
    rng = random.Random(5)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rows = [(i, "".join(rng.choices(letters[x] + " ", k=40)), x) for i, x in enumerate(rng.choices(sorted(letters), k=300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    got = {r.doc_id: (r.p.lang, r.p.score) for r in df.select("doc_id", langid.predict(df, model).alias("p")).collect()}
    for i, text, _ in rows:
        ((buckets, times),) = langid.counts(pa.array([text]))
        value = [(1 + np.log(t)) * model.idf[b] for b, t in zip(buckets, times)]
        length = sum(v * v for v in value) ** 0.5
        raw = [sum(v / length * model.weights[b, c] for v, b in zip(value, buckets)) + model.bias[c] for c in range(3)]
        chance = np.exp(np.array(raw) / model.temperature)
        assert got[i][0] == model.languages[int(np.argmax(raw))] and got[i][1] == pytest.approx(chance.max() / chance.sum())


def test_rare_languages_stay_learnable(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choices("abcde ", k=30)), "common") for _ in range(4000)] + [("".join(rng.choices("vwxyz ", k=30)), "rare") for _ in range(6)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), rows=200)
    assert model.languages == ["common", "rare"]
    assert model.predict(pa.array(["vwx zyx wvz", "abc edc bad"]))[0] == ["rare", "common"]
