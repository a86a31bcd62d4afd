"""Edge rows of the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from propflow.functions.annotation import property_label, with_annotation_value
from propflow.functions.keywords import matches_in_all, matches_keywords, smallest_cover
from propflow.functions.metrics import in_domain, regression_metrics
from propflow.functions.numbers import (
    convert_units,
    decode_number,
    encode_number,
    fixed4,
    guarded_confidence,
    guarded_log10,
)
from propflow.functions.responses import memo_key, parse_response, parse_short_response
from propflow.functions.symbols import labels_of, pack_sequence, pad_right, split_symbols
from propflow.functions.text import html_to_text, mention_windows, route_of, snippet_score


def values(spark, rows, schema, *columns):
    out = spark.createDataFrame(rows, f"k int, {schema}").select("k", *columns).orderBy("k").collect()
    return [tuple(row)[1:] if len(row) > 2 else row[1] for row in out]


def numbered(*items):
    return [(i, item) for i, item in enumerate(items)]


def test_annotation_value(spark):
    payloads = [
        '{"Value":{"Number":[5,6]}}',
        '{"Value":{"Number":[]}}',
        '{"Value":{"StringWithMarkup":[{"String":"a"},{"Markup":1},{"String":"b"}]}}',
        '{"Value":{"StringWithMarkup":[{"Markup":1}]}}',
        '{"Value":{"Boolean":[true]}}',
        "{}",
        "not json",
        '{"Value":{"Number":[1.5],"StringWithMarkup":[{"String":"no"}]}}',
        None,
    ]
    rows = with_annotation_value(spark.createDataFrame(numbered(*payloads), "k int, data string"), "data")
    got = [(r.value_text, r.value_num, r.bad_record) for r in rows.orderBy("k").collect()]
    assert got == [
        ("5", 5.0, False),
        (None, None, False),
        ("a b", None, False),
        ("", None, False),
        (None, None, False),
        (None, None, False),
        (None, None, True),
        ("1.5", 1.5, False),
        (None, None, False),
    ]


def test_property_label(spark):
    label = property_label(F.lit("s"), F.lit("h"), F.col("x"))
    assert values(spark, numbered('{"Name":"n"}', "{}"), "x string", label) == ["s - h - n", "s - h - "]


def test_keyword_modes(spark):
    word = ["environmental fate (complete)"]
    text = numbered("Environmental Fate (Complete)", "environmental fate complete", None, "other")
    got = values(
        spark, text, "x string",
        matches_keywords(F.col("x"), word),
        matches_keywords(F.col("x"), word, "regex"),
        matches_keywords(F.col("x"), ["fate"], "word"),
        matches_keywords(F.col("x"), ["fat"], "word"),
        matches_keywords(F.col("x"), []),
    )
    assert got == [
        (True, False, True, False, False),
        (False, True, True, False, False),
        (False, False, False, False, False),
        (False, False, False, False, False),
    ]


def test_keyword_quotes_and_many_words(spark):
    words = [r"a\Eb", "x.y", *(f"word{i}" for i in range(300))]
    text = numbered(r"A\eB", "xzy", "x.y", "word299", "wor")
    assert values(spark, text, "x string", matches_keywords(F.col("x"), words)) == [True, False, True, True, False]
    word_mode = matches_keywords(F.col("x"), [r"a\Eb", "x.y"], "word")
    assert values(spark, text, "x string", word_mode) == [True, False, True, False, False]


def test_keyword_in_both_columns(spark):
    rows = [(0, "Toxic", "acute"), (1, "Toxic", None), (2, "none", "acute")]
    both = matches_in_all([F.col("a"), F.col("b")], ["toxic", "acute"], "regex")
    assert values(spark, rows, "a string, b string", both) == [True, False, False]


def test_smallest_cover_keeps_the_matches():
    assert smallest_cover(["toxicity", "tox", "water", "", "tox"]) == ["tox", "water"]


def test_encode_number(spark):
    got = values(spark, numbered(2.34, -2.34, -0.04, None, 0.0, -12.0), "x double", encode_number(F.col("x")))
    assert got == ["positive 2.3", "negative 2.3", "positive 0.0", None, "positive 0.0", "negative 12.0"]


def test_decode_number(spark):
    labels = ["positive 2.3", "ositive 10.5", "egative 10.5", "2.3", "x", "sitive 100.5", "tive 1.0", None, "-2.5"]
    got = values(spark, numbered(*labels), "x string", decode_number(F.col("x")))
    assert got == [2.3, 10.5, -10.5, 2.3, None, 100.5, None, None, -2.5]


def test_decode_inverts_encode(spark):
    numbers = [i / 7 - 20 for i in range(280)]
    got = values(spark, numbered(*numbers), "x double", decode_number(encode_number(F.col("x"))), F.round("x", 1))
    assert all(a == b for a, b in got)


def test_log_guards(spark):
    x, c = F.col("x"), F.col("c")
    rows = [(0, 1000.0, 5), (1, 0.0, 5), (2, -1.0, 5), (3, None, 5), (4, 10.0, None)]
    got = values(
        spark, rows, "x double, c int",
        guarded_log10(x, 1000.0), guarded_confidence(x, c),
        guarded_log10(x, floor=0.1), guarded_confidence(x, c, floor=True),
    )
    assert got == [
        (0.0, 5, 3.0, 5),
        (None, 0, -1.0, 5),
        (None, 0, -1.0, 5),
        (None, 0, None, 0),
        (-2.0, 0, 1.0, 0),
    ]


def test_convert_units(spark):
    rows = [(0, 0.0, 24.45), (1, 0.0, 0.0), (2, 0.0, None)]
    to_ppm = convert_units(F.col("x"), F.col("w"), "mg/L")
    back = convert_units(to_ppm, F.col("w"), "ppm")
    got = values(spark, rows, "x double, w double", to_ppm, back)
    assert got[0][0] == pytest.approx(3.0) and got[0][1] == pytest.approx(0.0, abs=1e-12)
    assert got[1:] == [(None, None), (None, None)]
    with pytest.raises(ValueError):
        convert_units(F.lit(1.0), F.lit(1.0), "kg")


def test_fixed4(spark):
    assert values(spark, numbered(1.00005, None), "x double", fixed4(F.col("x"))) == ["1.0001", None]


def test_metrics_edges(spark):
    rows = [(0, 1.0, 1.5), (1, 1.0, 2.0), (2, 1.0, None)]
    got = spark.createDataFrame(rows, "k int, a double, p double").agg(
        *regression_metrics(F.col("a"), F.col("p"))
    ).first()
    assert (got.n, got.mae, got.r2, got["corr"]) == (2, 0.75, None, None)
    assert got.rmse == pytest.approx(math.sqrt((0.25 + 1) / 2))


def test_in_domain(spark):
    assert values(spark, numbered(7, 6, None), "x int", in_domain(F.col("x"), 7)) == [1, 0, 0]


def test_responses(spark):
    rows = numbered('{"chemical_name":"c","units":"u","explanation":"e","lc50":1.5,"confidence":7}', "oops", None)
    got = values(spark, rows, "x string", parse_response(F.col("x")))
    assert [tuple(r) for r in got] == [("c", "u", "e", 1.5, 7.0), (None, None, None, None, 0.0), (None, None, None, None, 0.0)]
    short = values(spark, numbered('{"lc50_4hr_mg_L":2,"confidence":3}', "{"), "x string", parse_short_response(F.col("x"), "mg_L"))
    assert [tuple(r) for r in short] == [(2.0, 3.0), (None, 0.0)]


def test_memo_key_separates_nulls_and_versions(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "")], "x string, y string")
    keys = {r[0] for r in df.select(memo_key("f", "1", "x", "y")).collect()}
    keys |= {r[0] for r in df.select(memo_key("f", "2", "x", "y")).collect()}
    assert len(keys) == 6


def test_split_symbols(spark):
    got = values(spark, numbered("[C][=C].[O]", "", None), "x string", split_symbols(F.col("x")))
    assert got == [["[C]", "[=C]", ".", "[O]"], [], []]


def test_pad_right(spark):
    got = values(spark, numbered([1, 2, 3], [1], None), "x array<int>", pad_right(F.col("x"), 2, 9))
    assert got == [[1, 2], [1, 9], [9, 9]]


def test_pack_sequence(spark):
    long = list(range(1100))
    rows = [(0, [1, 2], [3], [4]), (1, long, [3], [4]), (2, None, [3], [4]), (3, [1], [], [4])]
    packed = pack_sequence(F.col("s"), F.col("p"), F.col("v"), 7, 8, 9)
    first = pack_sequence(F.col("s"), F.col("p"), F.col("v"), 7, 8, 9, drop_first=(1, 0, 0))
    got = values(spark, rows, "s array<int>, p array<int>, v array<int>", packed, first)
    assert got[0] == ([7, 1, 2, 8, 3, 9, 4], [7, 2, 8, 3, 9, 4])
    assert got[1][0] == [7, *long[:1024], 8, 3, 9, 4] and len(got[1][0]) <= 1 + 1024 + 1 + 256 + 1 + 256
    assert got[2] == (None, None)
    assert got[3][0] == [7, 1, 8, 9, 4]


def test_labels_of(spark):
    got = values(spark, numbered([5, 0]), "x array<int>", labels_of(F.col("x")), labels_of(F.col("x"), 0, True))
    assert got == [([5, 0], [5, -100])]


def test_html_to_text(spark):
    html = (
        '<!DOCTYPE html><STYLE>p{}</STYLE><script>var t="</p>";</script><!-- a\n<b> -->'
        "<p>a &lt;b&gt; &amp;amp; <b>c</b>&nbsp;d</p>"
    )
    assert values(spark, numbered(html, None), "x string", html_to_text(F.col("x"))) == ["a <b> &amp; c d", None]


def test_route(spark):
    got = values(spark, numbered("a.pdf", "a.pdf?x", "b.html"), "x string", route_of(F.col("x")))
    assert got == ["pdf", "html", "html"]


def windows(text, name, alias, window):
    return list(mention_windows(text, name, alias, window))


def test_snippet_windows():
    assert windows("abcdXabcd", "ABCD", None, 3) == [(0, "abc"), (5, "cdXabc")]
    assert windows("x.y", "x.y", "X.Y", 9) == [(0, "x.y"), (0, "x.y")]
    assert windows("xzy", "x.y", "", 9) == []
    assert windows("aaaa", "aa", None, 1) == [(0, "a"), (2, "aa")]
    assert windows(None, "a", "b", 1) == []
    assert windows("été 12-3 où", "où", "12-3", 2) == [(4, "é 12"), (9, "3 où")]


def test_snippet_score(spark):
    texts = [
        "x" * 40 + " Water ppm",
        "nothing",
        ("acute inhalation toxicity, inhalation LC50 4-hour mg/m3 " + "y" * 100),
        "y" * 99,
        "y" * 100,
    ]
    got = values(spark, numbered(*texts), "x string", snippet_score(F.col("x"), F.lit("water"), F.lit(None)))
    assert got == [1 + 2 - 1, -1, 4 + 1 + 1 + 4, -1, 0]
