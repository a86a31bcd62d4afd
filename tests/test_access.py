"""Keyword lists, intervals, grouped quantiles, two-key tables, stored sequences, sheets."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from propflow.catalog import access
from propflow.functions.keywords import matches_keywords
from propflow.operators import keyword_join, quantiles, scoring
from propflow.operators.lookup import StoredIndex
from propflow.operators.range_join import cell_of, range_join
from propflow.sources.indexed import IndexedTable
from propflow.sources.sinks import write_split_sheet
from propflow.sources.tables import read_split_sheet

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- keywords


TEXTS = ["The quick brown fox", "THE QUICK", "a.b+c", "xaby", "", None, "The quick brown fox", "naïve Ärger", "line one\nline two", "été_1 summer", "ab"]
WORDS = ["quick", "a.b", "ab", "Ärger", "b", "one\nline", "\\E(", "", "été", "summ", "zzzz", None, "brown fox", "QUICK"]


@pytest.mark.parametrize("mode", ["literal", "word"])
def test_hits_equal_one_look_per_keyword(spark, mode):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    words = spark.createDataFrame([(w,) for w in WORDS], "w string")
    found = {r.id: (r.n_keywords, r.first_keyword) for r in keyword_join.with_keywords(texts, "t", words, mode).collect()}
    expected = {i: [] for i in range(len(TEXTS))}
    for w in {w.lower() for w in WORDS if w}:
        hit = matches_keywords(F.lower("t"), [w], mode)
        for r in texts.where(hit).collect():
            expected[r.id].append(w)
    assert found == {i: (len(ws), min(ws, key=str.encode, default=None)) for i, ws in expected.items()}
    kept = {r.id for r in keyword_join.rows_with_keywords(texts, ["t"], words, mode).collect()}
    assert kept == {i for i, ws in expected.items() if ws}


def test_a_keyword_is_entered_once_under_its_rarest_gram(spark):
    grams = spark.createDataFrame([("k1", "the "), ("k2", "the "), ("k2", "he q"), ("k3", "he q"), ("k3", "e qu"), ("k1", "ab")], "key string, gram string")
    words = spark.createDataFrame([("the qu",), ("ab",), ("nowhere",)], "w string")
    assert {tuple(r) for r in keyword_join.keyword_index(grams, words).collect()} == {("the qu", "e qu"), ("ab", "ab")}


def test_no_cross_join_and_no_expression_per_keyword(spark):
    plan = plan_of(access.keyword_index(spark, SF))
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("contains(") <= 2
    assert access._keywords(spark, SF).count() > 2000


def test_edges_of_keyword_lists(spark):
    texts = spark.createDataFrame([(1, "abc")], "id int, t string")
    none = spark.createDataFrame([], "w string")
    assert [tuple(r) for r in keyword_join.with_keywords(texts, "t", none).collect()] == [(1, "abc", 0, None)]
    assert keyword_join.rows_with_keywords(texts, ["t"], none).collect() == []
    assert keyword_join.with_keywords(texts.where("false"), "t", texts.select("t")).collect() == []
    with pytest.raises(ValueError, match="regex"):
        keyword_join.keyword_hits(texts, "t", none, "regex")


@pytest.mark.parametrize("mode", ["literal", "word"])
def test_keywords_of_words_meet_no_text_in_vain(spark, mode, monkeypatch):
    draw = np.random.default_rng(5)
    syllables = ["an", "ther", "tion", "é", "x_", "9", "日本"]
    words = sorted({"".join(draw.choice(syllables, draw.integers(1, 5))) for _ in range(400)})
    texts = [" ".join(draw.choice(words, 30)) + draw.choice([".", "-b", "\u0301", "\u200d"]) for _ in range(25)] + ["a" * 70 + " " + "y" * 64]
    words += ["a" * 65, "a" * 64, "y" * 64, "the.r", "ther an", "-b"]
    df, table = spark.createDataFrame(list(enumerate(texts)), "id int, t string"), spark.createDataFrame([(w,) for w in words], "w string")
    looked = []
    by_grams = keyword_join._gram_hits
    monkeypatch.setattr(keyword_join, "_gram_hits", lambda d, k, *a: (looked.extend(r.keyword for r in k.collect()), by_grams(d, k, *a))[1])
    found = {r.id: (r.n_keywords, r.first_keyword) for r in keyword_join.with_keywords(df, "t", table, mode).collect()}
    holds = [F.col("t").contains(w) if mode == "literal" else F.col("t").rlike(f"(?U)\\b\\Q{w}\\E\\b") for w in words]
    looks = df.select("id", F.array(*holds).alias("hit")).collect()
    expected = {r.id: [w for w, hit in zip(words, r.hit, strict=True) if hit] for r in looks}
    assert found == {i: (len(ws), min(ws, key=str.encode, default=None)) for i, ws in expected.items()}
    pairs = keyword_join.keyword_hits(df, "t", table, mode)
    assert pairs.count() == pairs.distinct().count() == sum(map(len, expected.values()))
    assert set(looked) == {"a" * 65, "the.r", "ther an", "-b"}  # the others are joined as words


# ---- intervals


@pytest.mark.parametrize(("cells", "points", "intervals"), [(1, 8192, 512), (7, 20, 5), (64, 3, 2)])
def test_intervals_equal_brute_force(spark, cells, points, intervals):
    draw = np.random.default_rng(1)
    xs = [5.0] * 100 + [float(x) for x in draw.integers(0, 50, 150)] + [None, math.nan, math.inf, -3.5, 1e300]
    ends = [(float(a), float(a + b)) for a, b in zip(draw.integers(-5, 50, 60), draw.integers(-2, 30, 60), strict=True)]
    ends += [(5.0, 5.0), (-math.inf, math.inf), (None, 3.0), (4.0, None), (math.nan, 7.0), (9.0, 8.0), (5.0, 5.0)]
    df = spark.createDataFrame(list(enumerate(xs)), "id int, x double").repartition(4)
    spans = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "of int, low double, high double")
    met = range_join(df, "x", spans, "low", "high", cells, points, intervals)
    found = sorted((r.id, r.of) for r in met.collect())
    expected = sorted(
        (i, j) for i, x in enumerate(xs) for j, (a, b) in enumerate(ends)
        if None not in (x, a, b) and not any(map(math.isnan, (x, a, b))) and a <= x <= b
    )
    assert found == expected


@pytest.mark.parametrize(("cells", "points", "intervals"), [(1, 8192, 512), (7, 1, 1), (64, 3, 2), (33, 8192, 512)])
def test_totals_of_intervals_equal_brute_force(spark, cells, points, intervals):
    draw = np.random.default_rng(4)
    xs = [5.0] * 100 + [float(x) for x in draw.integers(0, 90, 250)] + [None, math.nan, math.inf, -3.5, 1e300]
    rows = [(x, None if i % 5 == 0 else (1 << 54) * (-1) ** (i // 3) + i, None if i % 3 == 0 else float(i % 11)) for i, x in enumerate(xs)]
    ends = [(float(a), float(a + b)) for a, b in zip(draw.integers(-5, 90, 80), draw.integers(-2, 60, 80), strict=True)]
    ends += [(5.0, 5.0), (-math.inf, math.inf), (None, 3.0), (4.0, None), (math.nan, 7.0), (9.0, 8.0), (5.0, 5.0), (200.0, 300.0)]
    df = spark.createDataFrame(rows, "x double, k bigint, y double").repartition(4)
    spans = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "of int, low double, high double")
    asked = {"n": ("count", "*"), "given": ("count", "k"), "k_sum": ("sum", "k"), "least": ("min", "k"), "y_sum": ("sum", "y"), "most": ("max", "y"), "top": ("max", "x")}
    met = range_join(df, "x", spans, "low", "high", cells, points, intervals, totals=asked)
    found = {r.of: tuple(r)[3:] for r in met.collect()}
    expected = {}
    for j, (a, b) in enumerate(ends):
        held = [r for r in rows if None not in (r[0], a, b) and not any(map(math.isnan, (r[0], a, b))) and a <= r[0] <= b]
        ks, ys = [r[1] for r in held if r[1] is not None], [r[2] for r in held if r[2] is not None]
        if held:
            expected[j] = (len(held), len(ks), sum(ks) if ks else None, min(ks, default=None), sum(ys) if ys else None, max(ys, default=None), max(r[0] for r in held))
    assert found == expected


def test_totals_tell_apart_what_a_double_does_not_and_write_no_pairs(spark):
    big = 1 << 60
    df = spark.createDataFrame([(big + i,) for i in range(5)], "x bigint")
    spans = spark.createDataFrame([(big + 1, big + 2)], "low bigint, high bigint")
    assert range_join(df, "x", spans, "low", "high", totals={"n": ("count", "*"), "s": ("max", "x")}).first()[2:] == (2, big + 2)
    # 4e10 pairs
    lines = spark.range(200_000).select((F.col("id") * 0.5).alias("x"), "id")
    wide = spark.range(200_000).select(F.col("id").alias("of"), F.lit(-1.0).alias("low"), F.lit(1e9).alias("high"))
    met = range_join(lines, "x", wide, "low", "high", totals={"n": ("count", "*"), "s": ("sum", "id")})
    assert met.agg(F.count("*"), F.min("n"), F.max("n"), F.max("s")).first()[:] == (200_000, 200_000, 200_000, 199_999 * 100_000)
    with pytest.raises(ValueError, match="no total"):
        range_join(df, "x", spans, "low", "high", totals={"n": ("median", "x")})


def test_whole_numbers_beyond_a_double_are_told_apart(spark):
    big = 1 << 60
    df = spark.createDataFrame([(big + i,) for i in range(5)], "x bigint")
    spans = spark.createDataFrame([(big + 1, big + 2)], "low bigint, high bigint")
    assert sorted(r.x - big for r in range_join(df, "x", spans, "low", "high").collect()) == [1, 2]
    with pytest.raises(ValueError, match="both sides"):
        range_join(df, "x", spans.withColumnRenamed("low", "x"), "x", "high")


def test_cells_by_bisection(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 2.0, 2.5, 9.0)], "x double")
    edges = F.array(*map(F.lit, [0.0, 1.0, 2.0]))
    assert [r.c for r in df.select(cell_of(F.col("x"), edges, 3).alias("c")).collect()] == [0, 1, 1, 2, 3, 3, 3]


def test_interval_join_has_no_nested_loop(spark):
    plan = plan_of(access.interval_join(spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# ---- quantiles


def test_grouped_quantiles_equal_numpy(spark):
    draw = np.random.default_rng(2)
    rows = [("hot", int(x), float(y)) for x, y in zip(draw.integers(0, 3, 400), draw.normal(size=400), strict=True)]
    rows += [(f"g{i % 40}", i % 7, float(draw.normal())) for i in range(700)] + [(None, 1, 2.5), (None, 3, None), ("empty", None, math.nan), ("one", 4, None)]
    df = spark.createDataFrame(rows, "g string, a int, b double").repartition(6)
    points = [0.0, 0.1, 0.5, 0.99, 1.0]
    found = {(r.g, r.column, r.point): (r.n, r.value) for r in quantiles.grouped_quantiles(df, ["g"], ["a", "b"], points).collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        for i, column in ((1, "a"), (2, "b")):
            xs = [r[i] for r in rows if r[0] == g and r[i] is not None and not math.isnan(r[i])]
            expected |= {(g, column, p): (len(xs), pytest.approx(np.quantile(xs, p), abs=1e-12)) for p in points if xs}
    assert found == expected
    assert quantiles.grouped_quantiles(df.where("false"), ["g"], ["a"]).collect() == []


def test_sketches_merge(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("day"), (F.col("id") * 7919 % 30_000).cast("double").alias("x"))
    days = quantiles.quantile_sketches(df, ["g", "day"], ["x"])
    merged = quantiles.sketch_quantiles(quantiles.merge_sketches(days, ["g"]), [0.1, 0.5, 0.9])
    for r in merged.collect():
        assert r.n == 10_000 and abs(r.value / 30_000 - r.point) < 0.03


# ---- two keys, buckets


def test_lookups_read_few_files(spark, tmp_path):
    df = spark.range(0, 4000, 1, 4).select((F.col("id") % 200).alias("k"), (F.col("id") * 13 % 500).alias("s"), F.col("id").alias("v"))
    table = IndexedTable(spark, str(tmp_path / "t"), "k", "s").write(df, ["v"], rows_per_file=100)
    whole = set(table.rows().inputFiles())
    by_key, by_second = table.by_key([7]), table.by_second([3, 499])
    assert sorted(r.v for r in by_key.collect()) == list(range(7, 4000, 200))
    assert sorted(r.v for r in by_second.collect()) == [r.v for r in df.where("s in (3, 499)").orderBy("v").collect()]
    assert len(by_second.inputFiles()) < len(whole) / 2
    assert "Exchange" not in plan_of(by_key) and "Exchange" not in plan_of(by_second)
    assert "In(k" in plan_of(by_key) or "EqualTo(k" in plan_of(by_key)
    assert table.by_second([-1]).collect() == []
    scanned = table.by_second([3, 499], most_files=1)
    assert sorted(r.v for r in scanned.collect()) == sorted(r.v for r in by_second.collect())


def test_bucketed_tables_meet_where_they_lie(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(access.bucketed_join(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan[plan.index("SortMergeJoin") :]


# ---- stored sequences


def test_lookup_reads_asked_ranges_only(spark, tmp_path):
    rows = [(i, [i // 2 % 400, i % 3], f"p{i}") for i in range(2000)] + [(9999, None, "none"), (5000, [], "empty")]
    store = spark.createDataFrame(rows, "row int, t array<int>, p string")
    index = StoredIndex(spark, str(tmp_path / "i"), "t", "row", ["p"]).write(store, files=8)
    first = {}
    for row, t, p in rows:
        if t is not None and (tuple(t) not in first or row < first[tuple(t)][0]):
            first[tuple(t)] = (row, p)
    asked = [[3, 0], [3, 1], [3, 2], [399, 0], [400], [], [-5], None, [3, 0]]
    queries = spark.createDataFrame(list(enumerate(asked)), "q int, t array<int>")
    got = {r.q: (r.row, r.p) for r in index.lookup(queries).collect()}
    assert got == {q: first.get(tuple(t), (None, None)) if t is not None else (None, None) for q, t in enumerate(asked)}
    few = queries.where("q < 3")
    every = spark.createDataFrame([(i, [i, 0]) for i in range(400)], queries.schema)
    assert len(index.ranges(few).inputFiles()) == 1 < len(index.ranges(every).inputFiles()) == 8
    nothing = queries.where("q = 7")
    assert index.lookup(nothing).collect()[0].row is None and index.lookup(queries.where("false")).collect() == []


# ---- scores


def test_many_candidates_of_a_long_vector(spark):
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(3, 32_000))
    ids = [[int(x) for x in draw.integers(0, 32_000, k % 4 + 1)] for k in range(200)] + [[5, None, 32_000], [None], []]
    rows = spark.createDataFrame([(i, v.tolist(), [(f"c{k:03}", t) for k, t in enumerate(ids)]) for i, v in enumerate(vectors)], "e int, logits array<double>, c array<struct<category: string, ids: array<int>>>")
    scores = scoring.candidate_scores(rows, "e", F.col("c"))
    plan = plan_of(scores)
    assert plan.count("Generate") == 1 and re.search(r"Generate inline.*, \[e#\d+\], false", plan)  # only the id goes beside a score
    got = {(r.e, r.category): r.logprob for r in scores.collect()}
    assert len(got) == 3 * 201
    for i, v in enumerate(vectors):
        total = np.log(np.exp(v).sum())
        for k, t in enumerate(ids[:201]):
            known = [x for x in t if x is not None and x < 32_000]
            assert got[i, f"c{k:03}"] == pytest.approx(sum(v[x] - total for x in known))


def test_candidate_scores_equal_scores_of_rows(spark):
    rows = [(1, [0.5, 1.0, -2.0], [("a", [0, 1]), ("b", [2, 9]), ("c", [None, 0])]), (2, [float(i) for i in range(5)], [("a", [4])])]
    df = spark.createDataFrame(rows, "e int, logits array<double>, c array<struct<category: string, ids: array<int>>>")
    long = df.select("e", "logits", F.inline("c")).select("e", "logits", "category", F.explode("ids").alias("token_id"))
    for options in ({}, {"length_normalised": True}, {"pad_token": 0}):
        new = {(r.e, r.category): r.logprob for r in scoring.candidate_scores(df, "e", F.col("c"), **options).collect()}
        old = {(r.e, r.category): r.logprob for r in scoring.category_scores(long, "e", "category", **options).collect()}
        assert new.keys() == old.keys() and all(new[k] == (old[k] if old[k] is None else pytest.approx(old[k])) for k in old)


# ---- sheets


def test_sheets_with_line_breaks_are_split(spark, tmp_path):
    texts = ["a\nb", "\\n", "\\\\n\r\n\\", 'say "x",\ty', " lead and trail ", None, "é\\r\\\n", "", "\\"] + [f"row {i}\n" * 40 for i in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").coalesce(1)
    path = write_split_sheet(df, str(tmp_path / "s"), ["id", "t"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        back = read_split_sheet(spark, path, "id int, t string")
        tasks = back.rdd.getNumPartitions()
        got = {r.id: r.t for r in back.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    files = [f for f in (tmp_path / "s").iterdir() if re.match("part", f.name)]
    assert len(files) == 1 < tasks and len(got) == len(texts)
    assert {i: t or None for i, t in got.items()} == {i: t or None for i, t in enumerate(texts)}
