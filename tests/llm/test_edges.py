"""Defined results for NULL, empty, very long, tied and repeated rows, empty tables and
columns whose names clash, for every operator and stage."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
from lexivane.llm import contain, jaccard, langid, packing, pii, quality, rules, suffix, tokens, urls

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, id long, i long, t string, row string, "
    "h long, m long, seen string, email string, extra string, _spans string, _key string, _measured string, p string, c string, url string"
)
rng = random.Random(4)
LONG = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60_000))
PLAIN = " ".join(f"word{i} and" for i in range(60))
TEXTS = [None, "", " \n\t", "one", PLAIN, PLAIN, PLAIN, LONG, "x" * 50_000, "\u00e9\U0001f600 \x00", PLAIN + " mail a@b.cd"]
CLASH = (None, 7, None, "z", "z", 1, 2, None, "z", "z", "z", "z", "z", "z", "z", "http://a.example.com/")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), *CLASH[:1], *CLASH[1:]) for i, t in enumerate(TEXTS)]
    rows += [(None, t, None, None, None, *CLASH) for t in (None, "", PLAIN)]  # NULL ids
    rows.append(rows[4])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, PLAIN[:200]), (4, PLAIN[:200]), (None, PLAIN[:90])], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 1, 0), (7, 0, 0), (8, 0, 1), (9, None, 0), (None, 1, 0), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")


def scan_report(df):
    scanned = pii.scan(df)
    return pii.report(pii.find_pii(scanned, pii.learn_patterns(scanned)))


PER_ROW = {
    "tokens": lambda d, items, labels: tokens.count_tokens(d, PATH),
    "rules": lambda d, items, labels: rules.apply_policy(rules.rule_ledger(d)),
    "jaccard": lambda d, items, labels: jaccard.near_duplicates(d),
    "quality": lambda d, items, labels: quality.classify_quality(d, labels),
    "langid": lambda d, items, labels: langid.identify(d),
    "pii": lambda d, items, labels: scan_report(d),
    "suffix": lambda d, items, labels: suffix.dedup_substrings(d),
    "urls": lambda d, items, labels: urls.filter_urls(d.withColumnRenamed("doc_id", "page_id"), [urls.Rule("allow", "com/")]),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_per_row(docs, items, labels, name):
    got = PER_ROW[name](docs, items, labels)
    key = "page_id" if name == "urls" else "doc_id"
    rows = [r[key] for r in got.collect()]
    want = [r.doc_id for r in docs.select("doc_id").collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_empty_table(docs, items, labels, name):
    full, none = PER_ROW[name](docs, items, labels), PER_ROW[name](docs.limit(0), items, labels.limit(0))
    assert none.columns == full.columns and none.count() == 0


def test_empty_tables_of_the_others(docs, items):
    assert contain.find_contained(docs.limit(0), items).count() == 0
    assert contain.find_contained(docs, items.limit(0)).count() == 0
    assert contain.decontaminate(docs, items.limit(0)).count() == docs.count()
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_tokens_of_nothing(docs):
    got = {r.doc_id: r for r in tokens.count_tokens(docs.filter("doc_id < 4"), PATH).collect()}
    assert [(got[i].n_bytes, got[i].n_tokens, got[i].over_limit) for i in range(3)] == [(0, 0, False), (0, 0, False), (3, 0, False)]


def test_classes(docs):
    got = {}
    for r in jaccard.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, []).append((r.class_id, r.n_links, r.n_copies))
    assert got[0] == [(0, 0, 1)] and got[1] == [(1, 0, 1)] and got[2] == [(2, 0, 1)]  # no words, no links
    assert got[4] == [(4, 5, 5)] * 2 and got[5] == [(4, 5, 5)]  # copies, and the text with a word more
    assert got[10] == [(4, 5, 1)] and got[7] == [(7, 0, 1)]
    assert sorted(got[None], key=str) == sorted([(None, 0, 1), (None, 0, 1), (4, 5, 5)], key=str)


def test_contained_items(docs, items):
    got = [(r.doc_id, r.item_id) for r in contain.find_contained(docs, items).collect()]
    assert got.count((3, 3)) == 1  # an item of one word: only the document of that word
    for doc in (5, 6, 10):
        assert got.count((doc, 4)) == 2 and got.count((doc, None)) == 1
    assert got.count((4, 4)) == 4 and not any(d in (0, 1, 2, 7, 8, 9) for d, _ in got)


def test_packing_of_nothing(docs):
    rows = packing.pack_documents(docs, PATH).collect()
    empty = [r for r in rows if r.doc_id in (0, 1, 2)]
    assert [(r.piece, r.n_tokens, r.bin_id, r.bin_length) for r in empty] == [(0, 0, None, None)] * 3
    assert {r.doc_id for r in rows} == {*range(len(TEXTS)), None}


def test_undetermined_language(docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[4][0] == "en"


def test_scores_without_labels_of_both_kinds(docs, labels):
    for some, want in ((labels.limit(0), 0.5), (labels.filter("quality = 1 and doc_id <> 5"), 1.0)):
        assert {r.score for r in quality.classify_quality(docs, some).collect()} == {want}


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, stage, tmp_path):
    step = dict(corpus_pipeline.STAGES)[stage]
    spark.createDataFrame([(1, None), (2, "no such words in any of these texts")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = docs.drop("url")
    got, none = step(spark, own, str(tmp_path)), step(spark, own.limit(0), str(tmp_path))
    assert none.count() == 0 and none.columns == got.columns
    rows = got.collect()
    if stage != "bestfit_packing":
        assert got.columns == own.columns and got.schema["text"] == own.schema["text"]
    count = {"quality_rules": 7, "ngram_jaccard": 10, "decontamination": 15, "personal_data": 15}
    if stage in count:
        assert len(rows) == count[stage]
    if stage == "personal_data":
        assert [r.text for r in rows if r.doc_id == 10] == [PLAIN + " mail [EMAIL]"]
        assert [r.text for r in rows if r.doc_id == 0] == [None]
