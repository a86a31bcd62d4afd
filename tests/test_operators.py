"""Operators against brute force, edge rows and hot groups."""

import json
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from propflow.fixed_values import LICENSE_RULE
from propflow.functions.text import mention_windows
from propflow.operators import context, crosswalk, evaluate, exemplars, inference, lookup, ordering, reconcile
from propflow.operators import retrieval, scoring, split, tokens
from propflow.operators.assemble import assemble_property_table, melt, structures
from propflow.operators.ordering import OrderStatistics
from propflow.sources import sinks, tables
from propflow.sources.search import flatten_responses


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 numbers, one of them on a third of the rows."""
    rng = random.Random(7)
    data = [5.5 if i % 3 == 0 else round(rng.uniform(0, 10), 2) for i in range(3000)]
    return data, spark.createDataFrame(list(enumerate(data)), "id bigint, x double").repartition(16)



@pytest.fixture(params=[True, False], ids=["coalesced", "spread"])
def partitions(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param).lower())
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_order_statistics(skewed, partitions):
    data, df = skewed
    stats = OrderStatistics(df, "x")
    ordered = sorted(data)
    ranks = [0, 1, 17, 1234, 2998, 2999]
    assert stats.at(ranks) == {r: ordered[r] for r in ranks}
    points = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    assert stats.quantiles(points) == pytest.approx(list(np.quantile(data, points)), abs=1e-12)
    edges, got = stats.intervals([0.0, 0.25, 0.5, 0.75, 1.0])
    medians = [statistics.median(v for v in data if lo <= v <= hi) for lo, hi in zip(edges, edges[1:])]
    assert got == pytest.approx(medians)


def test_order_statistics_skip_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "x double")
    assert OrderStatistics(df, "x").quantiles([0.5]) == [2.0]
    empty = OrderStatistics(df.where("x > 9"), "x")
    assert empty.n == 0 and empty.quantiles([0.5]) == [] and empty.intervals([0.5, 1.0]) == ([], [])


def test_global_rank(skewed, partitions):
    data, df = skewed
    got = {r.id: r.rank for r in ordering.global_rank(df, "x", "id").collect()}
    order = sorted(range(len(data)), key=lambda i: (data[i], i))
    assert got == {i: n + 1 for n, i in enumerate(order)}


def test_rank_in_group(spark, partitions):
    data = [("hot" if i % 3 == 0 else None if i % 3 == 1 else f"g{i % 7}", i) for i in range(900)]
    random.Random(3).shuffle(data)
    df = spark.createDataFrame(data, "g string, i int").repartition(8)
    got = {(r.g, r.i): r["rank"] for r in ordering.rank_in_group(df, ["g"], ["i"]).collect()}
    groups = {}
    for g, i in sorted(data, key=lambda t: t[1]):
        groups.setdefault(g, []).append(i)
    assert got == {(g, i): n for g, items in groups.items() for n, i in enumerate(items)}


def test_nth_smallest_hash(spark):
    hashes = sorted(f"{i * 7919 % 100003:08x}" for i in range(500)) + ["ffffffff"] * 40
    df = spark.createDataFrame([(h,) for h in hashes], "h string")
    for n in (1, 2, 250, 500, 501, 540):
        assert ordering.nth_smallest_hash(df, "h", n, digits=2) == hashes[n - 1]
    assert ordering.nth_smallest_hash(df, "h", 0) is None
    with pytest.raises(ValueError):
        ordering.nth_smallest_hash(df, "h", 541)


@pytest.mark.parametrize("n,test", [(101, 11), (100, 10), (1, 1), (30, 3)])
def test_split_sizes(spark, n, test):
    df = spark.range(n)
    got = rows_of(split.split_exact(df, "id"))
    assert sum(part == "test" for _, part in got) == test
    assert got == rows_of(split.split_exact(df.repartition(16), "id"))


def brute_context(data, cap, suffix="..."):
    groups = {}
    for e, o, line in sorted(data, key=lambda t: t[1]):
        if line is not None:
            groups.setdefault(e, []).append(line)
    out = {}
    for e, lines in groups.items():
        text = "\n".join(lines)
        out[e] = text[:cap] + suffix if len(text) > cap else text
    return out


def test_context_parts_hold_the_whole_text(spark):
    texts = [("hot", i, "é" * (i * 37 % 90)) for i in range(400)] + [("one", 0, "x" * 1000), ("none", 0, None), (None, 3, "a"), (None, 4, ""), ("empty", 1, "")]
    df = spark.createDataFrame(texts, "e string, o int, t string").repartition(7)
    found = {(r.e, r.part): r.text for r in context.context_parts(df, "e", F.col("t"), ["o"], part_chars=100).collect()}
    whole = {e: "\n".join(t for x, _, t in texts if x == e and t is not None) for e in ("hot", "one", None, "empty")}
    assert found == {(e, k): w[k * 100 : k * 100 + 100] for e, w in whole.items() for k in range(max(1, -(-len(w) // 100)))}


@pytest.mark.parametrize("cap", [1, 7, 50, 51, 52, 400, 10**6])
@pytest.mark.parametrize("spread", [1, 5])
def test_capped_context(spark, cap, spread):
    rng = random.Random(cap)
    data = []
    for i in range(600):
        entity = "hot" if i % 3 == 0 else f"e{rng.randrange(40)}"
        line = None if rng.random() < 0.05 else "éx"[i % 2] * rng.choice([0, 1, 3, 50, 51])
        data.append((entity, i, line))
    df = spark.createDataFrame(data, "e string, o int, line string").repartition(7)
    got = context.capped_context(df, "e", F.col("line"), ["o"], cap=cap, suffix="...", spread=spread)
    assert {r.e: r.details for r in got.collect()} == brute_context(data, cap)


def test_context_cut_at_the_default_cap(spark):
    df = spark.createDataFrame([("a", 1, "x" * 120_001), ("b", 1, "y" * 120_000)], "e string, o int, t string")
    got = {r.e: r.details for r in context.capped_context(df, "e", F.col("t"), ["o"]).collect()}
    assert got["a"] == "x" * 120_000 + "... (truncated)" and got["b"] == "y" * 120_000
    known = spark.createDataFrame([("a",), ("c",)], "e string")
    attached = context.attach_context(known, spark.createDataFrame([("a", "t")], "e string, details string"), "e")
    assert rows_of(attached) == [("a", "t"), ("c", "")]


@pytest.mark.parametrize("rows_per_part", [1, 4, 1000])
def test_digest_parts_hold_the_whole_text(spark, partitions, rows_per_part):
    rng = random.Random(5)
    data = [(f"e{0 if i % 3 == 0 else rng.randrange(5)}", f"h{rng.randrange(4)}", None if i % 9 == 0 else f"v{i}", i) for i in range(120)]
    df = spark.createDataFrame(data, "e string, h string, v string, o int").repartition(5)
    digest = context.entity_digest(df, "e", "h", "v", "o", rows_per_part)
    prompts = context.digest_prompts(digest, "e").orderBy("e", "step", "part").collect()
    for e in sorted({r[0] for r in data}):
        mine = [r for r in data if r[0] == e]
        heads = ", ".join(dict.fromkeys(r[1] for r in mine))
        body = " ".join(r[2] for r in mine if r[2] is not None)
        whole = "".join(r.text for r in prompts if r.e == e)
        start = f"For the chemical with DTXSID {e}, here are the details:\nHeadings:\n{heads}\nDetails:\n{body}\n\nQuestion: "
        assert whole.startswith(start) and whole.endswith("(mg/L)?")


def test_exemplars_lie_in_their_bins(skewed):
    data, df = skewed
    points = [0.0, 0.25, 0.5, 0.75, 1.0]
    edges = exemplars.quantile_edges(df, "x", points)
    picked = exemplars.pick_exemplars(df, "x", "id", points).collect()
    assert len(picked) == 2 + 2 * 4
    lows = min((v, i) for i, v in enumerate(data))
    top = max(data)
    assert [(r.x, r.id) for r in picked if r.kind == "min"] == [lows]
    assert [(r.x, r.id) for r in picked if r.kind == "max"] == [(top, data.index(top))]
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = [(v, k) for k, v in enumerate(data) if lo <= v <= hi]
        middle = statistics.median(v for v, _ in inside)
        nearest = sorted(inside, key=lambda t: (abs(t[0] - middle), t[1]))[:2]
        assert {(r.x, r.id) for r in picked if r.kind == f"bin{i}"} == set(nearest)
    unique = exemplars.pick_exemplars(df, "x", "id", points, dedupe=True)
    assert unique.count() == len({r.id for r in picked})


def test_no_values_give_no_exemplars(spark):
    df = spark.createDataFrame([(1, None)], "id int, x double")
    assert exemplars.pick_exemplars(df, "x", "id").collect() == []


def test_infinite_edges(spark):
    df = spark.createDataFrame([(-math.inf,), (0.5,), (math.inf,)], "x double")
    got = rows_of(exemplars.interval_members(df, "x", [-math.inf, 1e-05, math.inf]))
    assert got == [(-math.inf, 0), (0.5, 1), (math.inf, 1)]


def test_inner_edge_lies_in_two_bins(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    got = rows_of(exemplars.interval_members(df, "x", [1.0, 2.0, 3.0]))
    assert got == [(1.0, 0), (2.0, 0), (2.0, 1), (3.0, 1)]


def test_sketched_edges_are_close(skewed):
    data, df = skewed
    edges = exemplars.quantile_edges(df, "x", [0.1, 0.9], accuracy=10_000)
    assert edges == pytest.approx(list(np.quantile(data, [0.1, 0.9])), abs=0.05)


def test_singletons(spark):
    df = spark.createDataFrame([(1, [7]), (2, [7, 8]), (3, []), (4, None)], "k int, ids array<bigint>")
    assert rows_of(crosswalk.unwrap_singletons(df, "ids")) == [(1, 7)]


def test_crosswalk_fans_out_unless_strict(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    pairs = spark.createDataFrame([(1, "D1"), (1, "D2"), (2, "D3")], "id int, d string")
    assert rows_of(crosswalk.attach_ids(rows, pairs, "id").na.fill("-")) == [
        (1, "a", "D1"), (1, "a", "D2"), (2, "b", "D3"), (3, "c", "-"),
    ]
    assert rows_of(crosswalk.duplicate_keys(pairs, "id")) == [(1, 2)]
    with pytest.raises(ValueError):
        crosswalk.attach_ids(rows, pairs, "id", strict=True)


def test_overlap_trims_all_white_space(spark):
    a = spark.createDataFrame([(" 1\t",), ("2",), ("2",), (None,)], "x string")
    b = spark.createDataFrame([(1,), (2,), (3,)], "y int")
    assert crosswalk.overlap_count(a, "x", b, "y").first().overlap == 2


def test_name_join_nulls(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "name string, a int")
    b = spark.createDataFrame([("x", 3), (None, 4)], "name string, b int")
    assert {r.b for r in crosswalk.name_join(a, b, "name", "left").collect()} == {3, None}
    assert {r.b for r in crosswalk.name_join(a, b, "name", "left", null_safe=True).collect()} == {3, 4}


def test_first_seen(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, o int")
    assert [r.k for r in crosswalk.first_seen(df, "k", "o", 2).collect()] == ["b", "a"]


def test_melt_keeps_or_drops_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, None)], "id int, mg double, ppm double")
    labels = {"mg": "M", "ppm": "P"}
    assert sorted(r.property for r in melt(df, ["id"], labels).collect()) == ["M", "P"]
    assert rows_of(melt(df, ["id"], labels, keep_null=False)) == [(1, "M", 1.0)]


def test_property_table_needs_structure_and_value(spark):
    eav = spark.createDataFrame(
        [("1", "PUBCHEM_OPENEYE_CAN_SMILES", "CC"), ("2", "other", "x"), ("z", "PUBCHEM_OPENEYE_CAN_SMILES", "C")],
        "id string, property string, value string",
    )
    compounds = structures(eav, "cid").withColumn("symbols", F.lit("[C][C]"))
    labelled = spark.createDataFrame([(1, "p", "v"), (2, "p", "v")], "cid bigint, property string, value string")
    measured = spark.createDataFrame([(1, "D", "q", 1.5), (1, "D", "q", None)], "cid bigint, alt string, property string, value double")
    got = assemble_property_table(compounds, labelled, measured, "cid", "alt", "symbols").na.fill("-")
    assert rows_of(got) == [
        (1, "-", "[C][C]", ["[C]", "[C]"], "p", "v"),
        (1, "D", "[C][C]", ["[C]", "[C]"], "q", "1.5"),
    ]


def test_vocabulary_is_dense_and_extends(spark, partitions):
    df = spark.createDataFrame([(["b", "a", None],), (["b"],), (None,)], "s array<string>")
    base = tokens.fit_vocabulary(df, F.col("s"), ["<pad>", "a"])
    assert rows_of(base) == [("<pad>", 0), ("a", 1), ("b", 2)]
    more = spark.createDataFrame([("d",), ("b",), ("c",), ("d",)], "symbol string")
    assert rows_of(tokens.extend_vocabulary(base, more)) == [("<pad>", 0), ("a", 1), ("b", 2), ("c", 3), ("d", 4)]


def test_encode_columns(spark):
    vocabulary = spark.createDataFrame([("a", 5), ("b", 6)], "symbol string, idx int")
    data = [(1, ["a", "x", "b"]), (2, []), (3, None), (4, ["b", None, "b"]), (5, ["a"])]
    df = spark.createDataFrame(data, "id int, s array<string>")
    got = tokens.encode_columns(df, {"s": "e"}, vocabulary, unknown=9)
    assert {r.id: r.e for r in got.collect()} == {1: [5, 9, 6], 2: [], 3: None, 4: [6, 9, 6], 5: [5]}


def test_encode_columns_with_repeated_keys_and_symbols(spark):
    vocabulary = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "symbol string, idx int")
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (None, ["b"])], "id int, s array<string>")
    got = tokens.encode_columns(df.withColumn("t", F.reverse("s")), {"s": "e", "t": "f"}, vocabulary)
    assert sorted((r.e, r.f) for r in got.collect()) == [([1, 3], [3, 1]), ([3], [3]), ([3], [3])]


def test_encode_padded(spark):
    vocabulary = spark.createDataFrame([("a", 5)], "symbol string, idx int")
    df = spark.createDataFrame([(1, ["a"] * 121), (2, None), (3, ["z"])], "id int, s array<string>")
    unk = tokens.encode_padded(df, "s", vocabulary, "e", 120, pad=0, unknown=9)
    got = {r.id: r.e for r in unk.collect()}
    assert got == {1: [5] * 120, 2: [0] * 120, 3: [9] + [0] * 119}
    pad = tokens.encode_padded(df, "s", vocabulary, "e", 120, pad=0, unknown=9, oov="pad")
    assert {r.id: r.e for r in pad.collect()}[3] == [0] * 120


def test_pad_to_longest(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([4],), ([],)], "t array<int>")
    assert sorted(r.p for r in tokens.pad_to_longest(df, "t", "p").collect()) == [[0, 0, 0], [1, 2, 3], [4, 0, 0]]


def test_sequence_lookup_takes_the_first_row(spark):
    store = spark.createDataFrame(
        [(9, [1, 2], "late"), (3, [1, 2], "early"), (4, [1], "short")], "row int, t array<int>, p string"
    )
    queries = spark.createDataFrame([("q1", [1, 2]), ("q2", [2, 1]), ("q3", [1])], "q string, t array<int>")
    got = lookup.lookup_sequences(queries, store, "t", "row", ["p"]).select("q", "row", "p")
    assert {r.q: (r.row, r.p) for r in got.collect()} == {"q1": (3, "early"), "q2": (None, None), "q3": (4, "short")}


def test_sorted_index_is_lexicographic(spark, partitions):
    rng = random.Random(1)
    seqs = [[rng.randrange(4) for _ in range(rng.randrange(5))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(seqs)), "row int, t array<int>").repartition(6)
    got = [r.row for r in lookup.sorted_index(df, "t", "row").orderBy("place").collect()]
    assert got == sorted(range(200), key=lambda i: (tuple(seqs[i]), i))


def test_snippets_leave_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "OUTPUT_CHARS", 40)
    texts = ["aXbXc" * 9, None, "none", "x"]
    df = spark.createDataFrame([(i, t, "X", None) for i, t in enumerate(texts)], "id int, t string, n string, a string")
    got = retrieval.explode_snippets(df, "t", "n", "a", ["id", "n"], window=3).collect()
    want = [
        (i, "X", p, s, t)
        for i, text in enumerate(texts)
        for p, (s, t) in enumerate(mention_windows(text, "X", None, 3))
    ]
    assert sorted(map(tuple, got)) == want and len(want) == 19


def test_top_snippets_are_stable_and_prompted(spark):
    data = [("e", d, p, s, f"s{d}{p}") for d in range(4) for p in range(3) for s in [(d + p) % 3]]
    df = spark.createDataFrame(data, "e string, d int, pos int, score int, snippet string")
    top = retrieval.top_snippets(df, "e", ["d", "pos"])
    best = sorted(data, key=lambda r: -r[3])[:5]
    assert [r.snippet for r in top.orderBy("place").collect()] == [r[4] for r in best]
    entities = spark.createDataFrame([("e", "n", "c"), ("f", "m", "d")], "e string, name string, cas string")
    prompts = {r.e: r.prompt for r in retrieval.snippet_prompts(entities, top, "e", "name", "cas").collect()}
    assert prompts["e"].endswith("LC50 value of n with cas c in ppm.\n" + "\n\n".join(r[4] for r in best))
    assert prompts["f"].endswith("in ppm.\n")


def test_flatten_responses(spark):
    rule = {"_type": LICENSE_RULE, "license": {"name": "L", "url": "U"}}
    body = {"webPages": {"value": [
        {"name": "n", "url": "u", "snippet": "s", "contractualRules": [{"_type": "x"}, rule, rule]},
        {"url": "v"},
    ]}}
    df = spark.createDataFrame([("q", json.dumps(body)), ("r", "{}"), ("s", "bad")], "q string, b string")
    got = [tuple(r) for r in flatten_responses(df, "q", "b").collect()]
    assert got == [("q", "n", "u", "s", "L", "U"), ("q", None, "v", None, "", "")]


def test_codec_failures_give_null(spark):
    df = spark.createDataFrame([("3",), ("x",), (None,), ("",)], "s string")
    got = inference.apply_codec(df, "s", lambda s: int(s) * 2, "n", "long").collect()
    assert [(r.n, r.n_failed) for r in got] == [(6, False), (None, True), (None, False), (None, False)]


def test_infer_keeps_failures(spark):
    def model(text):
        if text == "bad":
            raise KeyError(text)
        return text.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id bigint, t string")
    got = rows_of(inference.infer(df, "id", ["t"], model).na.fill("-"))
    assert got == [(1, "A", "-"), (2, "-", "KeyError: 'bad'"), (3, "C", "-")]


def test_memo_asks_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(text):
        calls.add(1)
        if text == "bad":
            raise ValueError(text)
        return f"<{text}>"

    from propflow.functions.responses import memo_key

    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)] + [(99, "bad")], "id int, t string")
    asked = df.withColumn("memo_key", memo_key("f", "1", "t"))
    path = str(tmp_path / "memo")
    first = rows_of(inference.memoised_infer(asked, ["t"], model, path).select("id", "result", "memo_hit").na.fill("-"))
    assert calls.value == 4 and len(first) == 31 and not any(hit for *_, hit in first)
    second = inference.memoised_infer(asked, ["t"], model, path)
    again = rows_of(second.select("id", "result", "memo_hit").na.fill("-"))
    assert calls.value == 5  # only the failed request again
    assert [r[:2] for r in again] == [r[:2] for r in first]
    assert all(hit == (result != "-") for _, result, hit in again)
    assert spark.read.parquet(path).count() == 3


def test_endpoints_gather_to_one_row(spark):
    df = spark.createDataFrame([("a",), ("b",)], "dsstox string")
    asked = inference.explode_endpoints(df, ["mg", "ppm"])
    result = F.when(F.col("endpoint") == "mg", F.lit('{"lc50": 2, "confidence": 5}')).otherwise(F.lit("bad"))
    answers = asked.withColumn("result", result).withColumn("error", F.lit(None).cast("string"))
    got = inference.gather_endpoints(answers, ["dsstox"], ["mg", "ppm"])
    assert rows_of(got.na.fill(-1.0).na.fill("-")) == [("a", 2.0, 5.0, -1.0, 0.0, "-"), ("b", 2.0, 5.0, -1.0, 0.0, "-")]


def test_category_scores(spark):
    logits = [[0.0, 1.0, 2.0], [3.0, 0.0, 0.0]]
    rows = [
        (1, "x", 0, logits[0], 2), (1, "x", 1, logits[1], 0), (1, "x", 2, logits[1], None),
        (1, "y", 0, logits[0], 2), (1, "y", 1, logits[1], 9),
        (2, "b", 0, logits[0], 1), (2, "a", 0, logits[0], 1),
    ]
    df = spark.createDataFrame(rows, "e int, c string, pos int, logits array<double>, token_id int")

    def logp(v, i):
        return v[i] - np.log(np.exp(v).sum())

    got = {(r.e, r.c): r.logprob for r in scoring.category_scores(df, "e", "c").collect()}
    assert got[1, "x"] == pytest.approx(logp(logits[0], 2) + logp(logits[1], 0))
    mean = scoring.category_scores(df, "e", "c", length_normalised=True)
    assert {(r.e, r.c): r.logprob for r in mean.collect()}[1, "x"] == pytest.approx(got[1, "x"] / 2)
    padded = scoring.category_scores(df, "e", "c", pad_token=0)
    assert {(r.e, r.c): r.logprob for r in padded.collect()}[1, "x"] == pytest.approx(logp(logits[0], 2))
    best = scoring.best_category(scoring.category_scores(df.where("e = 2"), "e", "c"), "e", "c")
    assert best.first().c == "a"


def test_threshold_sweep_against_loops(spark):
    rng = random.Random(2)
    data = [(rng.random(), rng.random() if i % 5 else None, rng.choice([4, 5, 6, 7, 8, 9, None])) for i in range(200)]
    df = spark.createDataFrame(data, "a double, p double, c int")
    got = {r.threshold: r for r in evaluate.threshold_sweep(df, {"u": ("a", "p", "c")}).collect()}
    for t in (5, 6, 7, 8):
        pairs = np.array([(a, p) for a, p, c in data if p is not None and c is not None and c >= t])
        a, p = pairs.T
        assert got[t].n == len(pairs)
        assert got[t]["corr"] == pytest.approx(np.corrcoef(a, p)[0, 1])
        assert got[t].mae == pytest.approx(np.abs(a - p).mean())
        assert got[t].r2 == pytest.approx(1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum())


def test_reconcile(spark):
    rows = [(1, 0.0, 1.0, 8.0, 6.5), (2, 0.0, 1.0, 8.1, 6.5), (3, 0.0, 1.0, 5.0, 9.0), (4, 0.0, 1.0, 9.0, 1.0), (5, 0.0, 1.0, None, 1.0)]
    df = spark.createDataFrame(
        rows, "id int, pred_lc50_4hr_mg_L double, pred_lc50_4hr_ppm double, confidence_mgL double, confidence_ppm double"
    )
    gap = reconcile.confidence_gap(df, "confidence_mgL", "confidence_ppm")
    weights = spark.createDataFrame([(2, 24.45), (3, 24.45)], "id int, molecular_weight double")
    got = {r.id: r for r in reconcile.recompute_weaker(reconcile.attach_weights(gap, weights, "id")).collect()}
    assert set(got) == {2, 3, 4}
    assert got[2].recalculated_ppm == pytest.approx(3.0) and got[2].recalculated_mg_L is None
    assert got[3].recalculated_mg_L == pytest.approx(-2.0) and got[3].combined_ppm == 1.0
    assert got[4].recalculated_ppm is None and got[4].combined_ppm == 1.0


def test_submission_sheet(spark):
    entities = spark.createDataFrame([(2, "b"), (1, "a")], "ord int, id string")
    predictions = spark.createDataFrame([("a", 1.5, 7)], "id string, p double, c int")
    got = evaluate.submission_sheet(entities, predictions, "id", ["id"], "ord", "p", "c").orderBy("ord")
    assert got.columns == ["ord", "id", "p", "APPLICABILITY_DOMAIN", "CONFIDENCE"]
    assert [tuple(r) for r in got.collect()] == [(1, "a", 1.5, 1, 7), (2, "b", None, 0, None)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "words.txt").write_text("Toxic \n\ntoxic\nAcute\n")
    keywords = tables.read_keywords(spark, str(tmp_path / "words.txt"))
    assert tables.keyword_list(keywords) == ["acute", "toxic"]
    with pytest.raises(ValueError):
        tables.keyword_list(keywords, limit=1)
    vocabulary = {"symbol_to_index": {"<pad>": 0, "<sos>": 1, "[C]": 3}}
    (tmp_path / "v.json").write_text(json.dumps(vocabulary, indent=1))
    assert rows_of(tables.read_vocabulary(spark, str(tmp_path / "v.json"))) == [("[C]", 3)]
    df = spark.createDataFrame([(i, f"k{i % 3}", 'a "q", \n b') for i in range(50)], "PubChemCID int, key string, text string")
    path = sinks.write_table(df, str(tmp_path / "t"), files=5)
    assert tables.read_table(spark, path, normalise=True).columns == ["pub_chem_cid", "key", "text"]
    with pytest.raises(ValueError):
        tables.read_table(spark, path, "absent")
    with pytest.raises(ValueError):
        sinks.compact_parts(spark, path, path)
    assert spark.read.parquet(sinks.compact_parts(spark, path, str(tmp_path / "c"))).count() == 50
    sheet = sinks.write_sheet(df, str(tmp_path / "s"), ["text", "PubChemCID"])
    assert rows_of(tables.read_sheet(spark, sheet, "text string, id int")) == sorted((r.text, r.PubChemCID) for r in df.collect())
    ordered = sinks.write_sheet(df.repartition(3), str(tmp_path / "o"), ["key", "PubChemCID"], order="PubChemCID")
    lines = [line for f in sorted((tmp_path / "o").glob("*.csv")) for line in f.read_text().splitlines()[1:]]
    assert [int(line.split(",")[1]) for line in lines] == list(range(50))
    assert tables.read_sheet(spark, ordered, "key string, id int", line_breaks=False).count() == 50
    found = spark.read.parquet(sinks.write_lookup(df, str(tmp_path / "l"), "key", ["PubChemCID"]))
    assert found.where("key = 'k1'").count() == 17
    sinks.save_bucketed(df, "propflow_bucketed", "key", 4)
    left = spark.table("propflow_bucketed")
    joined = left.join(left.groupBy("key").count(), "key")
    assert joined.count() == 50


