"""The filtering stages and the line cleaning on edge rows, and limits that hold for unseen text."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from propflow.llm import decontaminate, mixing, ngram_join, perplexity, quality_rules, sharding, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, region string, rack string, shard string"
BASE = " ".join(f"word{i}" for i in range(60)) + "."
OTHER = " ".join(f"thing{i * 7}" for i in range(60)) + "."
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))


@pytest.fixture(scope="module")
def edge(spark):
    texts = [None, "", " \n\t", "one two", "one two", BASE, BASE, BASE + " more", LONG, OTHER]
    rows = [(i, t, "en", f"s{i % 2}" if i % 3 else None, 1, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [(None, BASE, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), rows[9], rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


def bag(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect())


def test_one_of_each_group_stays(edge):
    kept = ngram_join.drop_near_duplicates(edge)
    expected = bag(edge.where("doc_id is null or doc_id not in (4, 6, 7)"))
    assert kept.columns == edge.columns and bag(kept) == expected
    assert ngram_join.drop_near_duplicates(edge.where("false")).collect() == []


def test_texts_without_benchmark_passages_stay(spark, edge):
    benchmark = spark.createDataFrame([(1, BASE), (2, None), (3, "")], "item_id bigint, text string")
    kept = decontaminate.drop_leaked(edge, benchmark)
    assert kept.columns == edge.columns and bag(kept) == bag(edge.where("doc_id is null or doc_id not in (5, 6, 7)"))
    assert bag(decontaminate.drop_leaked(edge, benchmark.where("false"))) == bag(edge)
    assert decontaminate.drop_leaked(edge.where("false"), benchmark).collect() == []


def test_unlabelled_and_clean_rows_are_not_toxic(spark, edge):
    labels = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id bigint, toxic int")
    for marks in (labels, labels.where("false")):
        kept = toxicity.drop_toxic(edge, marks)
        assert kept.columns == edge.columns and bag(kept) == bag(edge)
    assert toxicity.drop_toxic(edge.where("false"), labels).collect() == []


def test_every_row_has_a_shard(edge):
    placed = sharding.assign_shards(edge, sharding.layout(16))
    assert bag(placed) == bag(edge) and placed.where("shard is null or region is null or rack is null").count() == 0
    assert len({r.shard for r in placed.where("doc_id = 9").collect()}) == 1
    assert sharding.assign_shards(edge.where("false"), sharding.layout(16)).collect() == []


def test_rows_without_words_come_once(edge):
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns
    blank = edge.where("trim(translate(coalesce(text, ''), '\n\t', '  ')) = ''")
    assert bag(mixed.where("trim(translate(coalesce(text, ''), '\n\t', '  ')) = ''")) == bag(blank)
    assert mixing.mix(edge.where("false")).collect() == []


def test_cleaning_drops_failing_lines_only(spark):
    good = "\n".join(" ".join(f"plain{chr(97 + i)}{chr(97 + k)}word" for k in range(9)).capitalize() + "." for i in range(12))
    bad = "Click here to subscribe to our newsletter"
    docs = spark.createDataFrame(
        [(1, f"{good}\n{bad}", "x"), (2, "too short", "x"), (3, None, "x"), (4, good, "x"), (1, f"{good}\n{bad}", "x")], "doc_id bigint, text string, kept string"
    )
    cleaned = quality_rules.clean_documents(docs)
    assert cleaned.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in cleaned.collect()) == {(1, good): 2, (4, good): 1}
    assert quality_rules.clean_documents(docs.where("false")).collect() == []
    texts = docs.select(quality_rules.clean_text(F.col("text")).alias("t"), "doc_id").collect()
    assert {r.doc_id: r.t for r in texts}[3] is None


def test_good_text_that_the_model_never_saw_is_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    unseen = F.col("doc_id") % 4 == 0
    found = {r.doc_id: r.kept for r in perplexity.quality_report(docs, labels.where(~unseen)).collect()}
    marks = labels.where(unseen).collect()
    good, noise = ([found[r.doc_id] for r in marks if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.95 * len(good)
    assert sum(noise) <= 0.2 * len(noise)


def test_models_of_all_folds_are_trained_at_once(spark):
    texts = [None, "", "ab", "ab", "abab ba", "été 日本", "b" * 50, "a b c", "abba", "cab"]
    docs = perplexity.dealt(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 3)
    models, floors = perplexity.train(docs, 3)
    found = {(r.m, r.k, r.g): r.w for r in models.collect()}
    assert sorted(floors) == [0, 1, 2, 3]
    for m in range(4):
        alone, floor = perplexity.train(docs.where(F.col("fold") != m).withColumn("fold", F.lit(0)), 1)
        own = {(r.k, r.g): r.w for r in alone.where("m = 1").collect()}
        assert own == pytest.approx({(k, g): w for (model, k, g), w in found.items() if model == m})
        assert floor[1] == pytest.approx(floors[m])


def test_unseen_limits_need_few_jobs(spark, edge):
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id bigint, quality int")
    context = spark.sparkContext
    context.setJobGroup("judged", "one training for all folds")
    try:
        assert perplexity.quality_report(edge, labels).count() == edge.count()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(context.statusTracker().getJobIdsForGroup("judged"))
    assert jobs <= 90
