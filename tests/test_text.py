import pytest
from pyspark.sql import functions as F

from planview import plan_of
from lexivane.functions.taxonomy import RECIPES, Taxonomy
from lexivane.functions.text import DOCUMENT_TEMPLATE, QUERY_PREFIX, compose, filled, hash_percent
from lexivane.operators import labels as L
from lexivane.operators.ranks import global_rank
from lexivane.operators.categorize import categorize, category_string, main_category

CASES = [
    ("Risoto de frango", "2 peitos de frango médios, 3 canecas de arroz", "misture tudo", ["Chicken", "Rice"]),
    ("Prato", "frango, sal", "asse", ["Other"]),
    ("Torta de legumes", "1 cebola, 2 ovos", "asse", ["Cake", "Dessert", "Pie", "Vegetarian"]),
    ("Salada", "1 pimentão vermelho, alface e sal", "misture", ["Dessert", "Salad"]),
    ("Pernil assado", "costela de porco e sal", "asse", ["Meat", "Pork"]),
    ("Filé", "mignon fatiado, legumes", "grelhe", ["Other"]),
    ("BOLO DE CACAU", "farinha", "misture", ["Cake", "Chocolate", "Dessert"]),
    ("Sopa", "legumes\ncarne\nsal", "ferva", ["Vegetarian"]),
    (None, None, None, ["Other"]),
    ("", "", "", ["Other"]),
    ("asa", "de frango", "com legumes", ["Chicken"]),
]


@pytest.fixture(scope="module")
def tagged(spark):
    rows = [(i, *c) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(
        rows, "i int, name string, ingredients string, instructions string, expected array<string>"
    )
    return categorize(df)


def test_rule_cases(tagged):
    for row in tagged.orderBy("i").collect():
        assert row.categories == row.expected, row


def test_against_row_by_row_rules(spark, sf):
    """The set-based form equals a literal substring reading of the rules."""
    taxonomy = Taxonomy(
        {"A": ("the", "and the"), "B": ("des", "une"), "C": ("und", "für die"), "D": ("los", "que")},
        barred_by=("C",), plain_stems=("ing", "eau"), sweet_from=("B",), sweet_words=("ción", "the"),
    )
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", F.col("source").alias("name"), F.substring_index("text", "\n", 1).alias("ingredients"),
        F.col("text").alias("instructions"),
    )

    def slow(n, g, s):
        n, g, s = n.lower(), g.lower(), s.lower()
        found = {
            c for c, words in taxonomy.keywords.items()
            if any(f" {w} " in f" {f} " for w in words for f in (n, g, s))
        }
        everything = f"{n} {g} {s}"
        if not any(f" {w} " in f" {everything} " for w in taxonomy.barred_words) and any(
            stem in everything for stem in taxonomy.plain_stems
        ):
            found.add("Vegetarian")
        if found & set(taxonomy.sweet_from) or any(w in g for w in taxonomy.sweet_words):
            found.add("Dessert")
        return sorted(found) or ["Other"]

    out = categorize(docs, taxonomy)
    assert "Python" not in plan_of(out) and "Exchange" not in plan_of(out)
    seen = set()
    for r in out.collect():
        assert r.categories == slow(r.name, r.ingredients, r.instructions)
        seen.update(r.categories)
    assert len(seen) >= 5


def test_taxonomy_sizes():
    sizes = [len(w) for w in RECIPES.keywords.values()]
    assert sizes == [7, 10, 7, 11, 8, 8, 5, 5, 5, 5, 3, 3, 5] and sum(sizes) == 82
    assert len(RECIPES.barred_words) == 36


def test_taxonomy_from_table(spark):
    table = spark.createDataFrame([("A", "x"), ("A", "y z"), ("B", "x")], "category string, keyword string")
    taxonomy = Taxonomy.from_table(table)
    assert taxonomy.keywords == {"A": ("x", "y z"), "B": ("x",)}
    with pytest.raises(ValueError):
        Taxonomy({"A": (" x",)})


def test_main_category_and_string(tagged):
    rows = tagged.select("i", main_category().alias("m"), category_string().alias("s")).orderBy("i").collect()
    assert (rows[2].m, rows[2].s) == ("Cake", "Cake, Dessert, Pie, Vegetarian")


def test_multi_hot_and_primary_label(tagged):
    hot, classes = L.multi_hot(tagged)
    assert classes == sorted(classes) and "Other" in classes
    for r in L.primary_label(hot, classes).collect():
        assert [c for c, bit in zip(classes, r.hot) if bit] == r.categories
        assert r.label == r.hot.index(1)


def test_encode_labels_both_ways(spark):
    df = spark.createDataFrame([(x,) for x in "pera uva maçã uva abacaxi pera".split()], "fruit string")
    expected = {"abacaxi": 0, "maçã": 1, "pera": 2, "uva": 3}
    assert {r.fruit: r.code for r in L.encode_labels(df, "fruit").collect()} == expected
    spread = global_rank(df.distinct(), "fruit", "code")
    assert {r.fruit: r.code for r in spread.collect()} == expected


def test_composition(spark):
    df = spark.createDataFrame([("Bolo", None, "asse")], "name string, ingredients string, instructions string")
    text, query = df.select(
        compose(DOCUMENT_TEMPLATE), F.concat(F.lit(QUERY_PREFIX), filled("name"))
    ).first()
    assert text == "receita de Bolo. ingredientes: . modo de preparo: asse"
    assert query == "receita de Bolo"


def test_hash_split_is_stable(spark):
    df = spark.range(5000)
    split = df.select("id", hash_percent("id").alias("p"))
    again = df.repartition(7).select("id", hash_percent("id").alias("p"))
    assert split.exceptAll(again).isEmpty()
    assert 0.17 < split.filter("p < 20").count() / 5000 < 0.23
