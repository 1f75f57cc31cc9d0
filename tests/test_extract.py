import pytest

from planview import plan_of
from lexivane.operators.extract import cap_rows, dedup_urls, extract_jsonld, extract_links, flatten_recipe

J1 = (
    '{"@type":"Recipe","name":"Bolo","image":{"url":"u"},"recipeIngredient":["a","b"],'
    '"recipeInstructions":[{"text":"x"},{"text":"y"}]}'
)


def page(*bodies):
    return "<html>" + "".join(f'<script type="application/ld+json">{b}</script>' for b in bodies) + "</html>"


def recipes(spark, html, **kw):
    df = spark.createDataFrame([(1, "http://p", html)], "page_id long, url string, html string")
    return flatten_recipe(extract_jsonld(df, **kw)).collect()


def test_j1_flat(spark):
    (r,) = recipes(spark, page(J1))
    assert (r.name, r.url, r.image_url, r.author, r.ingredients, r.instructions) == (
        "Bolo", "http://p", "u", None, "a, b", "x y",
    )


def test_j2_wrong_types_keep_the_row(spark):
    (r,) = recipes(spark, page('{"@type":"Recipe","image":["x"],"author":null,"keywords":["a","b"]}'))
    assert (r.image_url, r.author, r.keywords) == (None, None, '["a","b"]')


def test_j3_missing_step_text_is_empty(spark):
    (r,) = recipes(spark, page('{"@type":"Recipe","recipeInstructions":[{"text":"p"},{"x":1},{"text":"q"}]}'))
    assert r.instructions == "p  q"


@pytest.mark.parametrize("bad", ["{bad", "{'@type':'Recipe'}", '{"@type":"Recipe"', "  "])
def test_j4_bad_scripts_are_skipped(spark, bad):
    assert [r.name for r in recipes(spark, page(bad, J1))] == ["Bolo"]


def test_j5_first_of_two(spark):
    assert [r.name for r in recipes(spark, page('{"@type":"Recipe","name":"A"}', J1))] == ["A"]


@pytest.mark.parametrize("other", ['{"@type":"WebSite"}', '{"@type":["Recipe"],"name":"E"}', "{}"])
def test_j6_j8_other_types(spark, other):
    assert recipes(spark, page(other)) == []
    assert [r.name for r in recipes(spark, page(other, J1))] == ["Bolo"]


@pytest.mark.parametrize("stop", ['[{"@type":"Recipe","name":"D"}]', "3", ""])
def test_j7_strict_stops_at_non_objects(spark, stop):
    assert recipes(spark, page(stop, J1)) == []
    assert [r.name for r in recipes(spark, page(J1, stop))] == ["Bolo"]


def test_j7_arrays_on_request(spark):
    assert [r.name for r in recipes(spark, page('[{"@type":"Recipe","name":"D"}]'), if_array=True)] == ["D"]
    assert [r.name for r in recipes(spark, page("3", J1), if_array=True)] == ["Bolo"]


def test_j9_missing_lists_are_empty_text(spark):
    (r,) = recipes(spark, page('{"@type":"Recipe","name":"N"}'))
    assert (r.ingredients, r.instructions) == ("", "")


def test_ratings_quoted_or_bare(spark):
    body = '{"@type":"Recipe","aggregateRating":{"ratingValue":%s,"ratingCount":%s}}'
    for value, count in (("4.5", "12"), ('"4.5"', '"12"')):
        (r,) = recipes(spark, page(body % (value, count)))
        assert (r.rating_value, r.rating_count) == (4.5, 12)
    (r,) = recipes(spark, page(body % ('"many"', "null")))
    assert (r.rating_value, r.rating_count) == (None, None)


def test_script_text_is_not_seen(spark):
    inner = "<script>var s = '" + page(J1)[6:].split("</script>")[0] + "';</script>"
    assert recipes(spark, inner) == []
    later = recipes(spark, inner + page('{"@type":"Recipe","name":"A </b> <!-- x"}'))
    assert [r.name for r in later] == ["A </b> <!-- x"]


def test_commented_script_is_not_seen(spark):
    assert recipes(spark, "<!-- " + page(J1) + " -->") == []


LINKS = [
    ('<a href="/receita/1-a.html">', ["https://h/receita/1-a.html"]),
    ('<a class="c" href="/receita/2.html"><a class="c" href="/receita/2.html">', ["https://h/receita/2.html"] * 2),
    ('<a href="https://h/receita/3"><a href="/outra/4"><a>', []),
    ("<!-- <a href=\"/receita/5\"> --><script>var s='<a href=\"/receita/6\">'</script>", []),
    ('<a href="/receita/7?x=1&amp;y=2">', ["https://h/receita/7?x=1&y=2"]),
    ("<A title='a>b' HREF = '/receita/8'>", ["https://h/receita/8"]),
    ("<a href=/receita/9>", ["https://h/receita/9"]),
    ('<a data-href="/receita/10"><abbr href="/receita/11">', []),
    ("<a " + "x='y' " * 5000 + 'href="/receita/12">', ["https://h/receita/12"]),
    ("<a " + " " * 50000, []),
    (None, []),
]


@pytest.mark.parametrize("html,expected", LINKS)
def test_links(spark, html, expected):
    df = spark.createDataFrame([(1, "http://p/x", html)], "page_id long, url string, html string")
    assert [r.url for r in extract_links(df, "/receita/", "https://h").collect()] == expected


def test_links_relative_to_page(spark):
    df = spark.createDataFrame([(1, "http://p.org/x?y", '<a href="/z"><a href="/z">')], "page_id long, url string, html string")
    links = extract_links(df, "/", distinct_in_page=True)
    assert [r.url for r in links.collect()] == ["http://p.org/z"]


def test_dedup_and_cap(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    links = extract_links(pages, "/", "https://h")
    urls = dedup_urls(links)
    assert 0 < urls.count() < links.count()
    capped = cap_rows(urls, 5)
    assert [r.url for r in capped.collect()] == sorted(r.url for r in urls.collect())[:5]
    assert "TakeOrderedAndProject" in plan_of(capped)
    assert sorted(r.url for r in cap_rows(urls, 20, top_n_limit=5).collect()) == sorted(r.url for r in urls.collect())[:20]
    assert "Python" not in plan_of(urls)


def _links(spark, html):
    df = spark.createDataFrame([(1, "https://h/p", html)], "page_id long, url string, html string")
    return [r.url for r in extract_links(df, "/receita/", "https://h").collect()]


def test_attribute_order_and_references(spark):
    assert _links(spark, '<a title="see href=/receita/no here" href="/receita/yes">') == ["https://h/receita/yes"]
    assert _links(spark, "<a title='x'href='/receita/1' href='/receita/2'>") == ["https://h/receita/1"]
    assert _links(spark, '<a data-href="/receita/no" href=/receita/3?a=b/c>') == ["https://h/receita/3?a=b/c"]
    assert _links(spark, '<a disabled href = "&#47;receita&#x2F;x&amp;lt;&eacute;&unknown;&#0;">') == ["https://h/receita/x&lt;\u00e9&unknown;\ufffd"]
    assert _links(spark, "<a " + "x=1 " * 20_000 + "href=/receita/long>") == ["https://h/receita/long"]


def test_type_attribute_only(spark):
    page = '<script data-type="application/ld+json">{"@type":"Recipe","name":"no"}</script>' + "<script type='application/ld+json'>{\"@type\":\"Recipe\",\"name\":\"yes\"}</script>"
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert [r.record.name for r in extract_jsonld(df).collect()] == ["yes"]
