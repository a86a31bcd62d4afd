"""Stored answers in generations, requests in waves, patience with calls, texts brought down to one part."""

import re
import time

import pytest
from pyspark.sql import functions as F

from propflow.functions.responses import memo_key
from propflow.operators import inference
from propflow.operators.inference import Patience, attempt_call
from propflow.operators.memo import Memo
from propflow.operators.reduction import reduce_parts
from propflow.plans.estimates import estimate_whole, whole_prompts


def answers(spark, *rows):
    return spark.createDataFrame(list(rows), "memo_key string, result string, error string")


def stored(memo, prefixes=None):
    return {r.memo_key: (r.result, r.error, r.generation) for r in memo.latest(prefixes).collect()}


def test_last_writer_counts_and_errors_hide_nothing(spark, tmp_path):
    memo = Memo(spark, str(tmp_path / "memo"))
    assert memo.generations() == [] and stored(memo) == {}
    memo.commit(answers(spark, ("aa1", "old", None), ("ab1", None, "E"), ("b01", "only", None), ("c01", None, "first")))
    memo.commit(answers(spark, ("aa1", "new", None), ("ab1", "now", None), ("b01", None, "E"), ("c01", None, "second")))
    expected = {"aa1": ("new", None, 2), "ab1": ("now", None, 2), "b01": ("only", None, 1), "c01": (None, "second", 2)}
    assert stored(memo) == expected and memo.generations() == [1, 2]
    assert stored(memo, ["b0"]) == {"b01": ("only", None, 1)}
    assert memo.compact() == 3 and memo.generations() == [3]
    assert {k: v[:2] for k, v in stored(memo).items()} == {k: v[:2] for k, v in expected.items()}
    memo.commit(answers(spark, ("aa1", "newest", None)))
    assert memo.generations() == [3, 4] and stored(memo)["aa1"] == ("newest", None, 4)


def test_uncommitted_rows_are_not_read_and_are_replaced(spark, tmp_path):
    path = str(tmp_path / "memo")
    memo = Memo(spark, path)
    memo.commit(answers(spark, ("aa1", "x", None)))
    lost = answers(spark, ("aa1", "lost", None), ("ff1", "lost", None)).withColumn("prefix", memo.prefix())
    lost.write.partitionBy("prefix").parquet(f"{path}/data/generation=2")  # its log row was never written
    assert stored(memo) == {"aa1": ("x", None, 1)}
    assert memo.commit(answers(spark, ("bb1", "y", None))) == 2
    assert stored(memo) == {"aa1": ("x", None, 1), "bb1": ("y", None, 2)}


def test_only_asked_prefixes_are_read(spark, tmp_path):
    memo = Memo(spark, str(tmp_path / "memo"))
    memo.commit(answers(spark, *((f"{i:02x}0", str(i), None) for i in range(256))))
    read = memo.rows(["0a", "ff"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*prefix#\d+ IN \(0a,ff\)", plan)
    files = {f for r in read.select(F.input_file_name().alias("f")).collect() for f in [r.f]}
    assert {re.search("prefix=(..)", f)[1] for f in files} == {"0a", "ff"}


def requests(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return df.withColumn("memo_key", memo_key("f", "1", "t"))


def test_a_lost_wave_is_asked_again_and_no_other(spark, tmp_path):
    path, marker = str(tmp_path / "memo"), tmp_path / "broken"
    calls = spark.sparkContext.accumulator(0)
    asked = requests(spark, [f"text {i}" for i in range(120)] + ["text 7"])
    wave = {r.memo_key: int(r.memo_key[:2], 16) % 4 for r in asked.collect()}
    victim = next(r.t for r in asked.orderBy("id").collect() if wave[r.memo_key] == 2)
    marker.write_text("")

    def model(text):
        if text == victim and marker.exists():
            raise SystemExit("the machine is gone")
        calls.add(1)
        return text.upper()

    with pytest.raises(Exception, match="machine is gone"):
        inference.ask_in_waves(asked, ["t"], model, path, waves=4).collect()
    done = stored(Memo(spark, path))
    assert set(done) == {k for k, w in wave.items() if w < 2} and len(Memo(spark, path).generations()) == 2
    marker.unlink()
    before = calls.value
    got = {r.id: r for r in inference.ask_in_waves(asked, ["t"], model, path, waves=4).collect()}
    assert calls.value - before == 120 - len(done)
    assert all(r.result == r.t.upper() and r.error is None for r in got.values()) and len(got) == 121
    assert {r.memo_key for r in got.values() if r.memo_hit} == set(done)
    again = inference.ask_in_waves(asked, ["t"], model, path, waves=2)
    assert again.where("memo_hit").count() == 121 and calls.value - before == 120 - len(done)


def test_failures_stay_and_are_asked_by_the_next_run(spark, tmp_path):
    path, marker = str(tmp_path / "memo"), tmp_path / "broken"
    marker.write_text("")

    def model(text):
        if text == "b" and marker.exists():
            raise ValueError(text)
        return text * 2

    asked = requests(spark, ["a", "b", "a"])
    first = {r.id: (r.result, r.error, r.memo_hit) for r in inference.ask_in_waves(asked, ["t"], model, path).collect()}
    assert first == {0: ("aa", None, False), 1: (None, "ValueError: b", False), 2: ("aa", None, False)}
    marker.unlink()
    second = {r.id: (r.result, r.error, r.memo_hit) for r in inference.ask_in_waves(asked, ["t"], model, path).collect()}
    assert second == {0: ("aa", None, True), 1: ("bb", None, False), 2: ("aa", None, True)}
    assert inference.ask_in_waves(asked.where("false"), ["t"], model, path).collect() == []


def test_calls_are_tried_again_and_not_waited_for_without_end():
    tries = []

    def flaky(text):
        tries.append(time.monotonic())
        if len(tries) < 3:
            raise OSError("busy")
        return text

    assert attempt_call(flaky, ("x",), Patience(retries=2, delay=0.05)) == ("x", None)
    gaps = [b - a for a, b in zip(tries, tries[1:], strict=False)]
    assert len(tries) == 3 and gaps[0] >= 0.05 and gaps[1] >= 0.1
    tries.clear()
    assert attempt_call(flaky, ("x",), Patience(retries=1, delay=0)) == (None, "OSError: busy") and len(tries) == 2
    begun = time.monotonic()
    answer, error = attempt_call(lambda _: time.sleep(30), ("x",), Patience(timeout=0.1))
    assert answer is None and error == "TimeoutError: no answer within 0.1 s" and time.monotonic() - begun < 5
    assert attempt_call(str.upper, ("x",), Patience(timeout=5)) == ("X", None)


def test_a_hung_call_does_not_hold_its_task(spark):
    def model(text):
        if text == "hang":
            time.sleep(3600)
        return text

    asked = spark.createDataFrame([(1, "a"), (2, "hang"), (3, "b")], "id int, t string")
    got = {r.id: r.error for r in inference.infer(asked, "id", ["t"], model, patience=Patience(timeout=0.5)).collect()}
    assert got == {1: None, 2: "TimeoutError: no answer within 0.5 s", 3: None}


# ---- reduction


def parts_of(spark, texts):
    rows = [(e, f"name {e}", i, t) for e, parts in texts.items() for i, t in enumerate(parts)]
    return spark.createDataFrame(rows, "dsstox string, name string, part int, text string")


def reduced(spark, texts, refine, path, **options):
    found = reduce_parts(parts_of(spark, texts), "dsstox", "name", refine, path, **options).collect()
    return {e: [r.text for r in sorted(found, key=lambda r: r.part) if r.dsstox == e] for e in texts}


def test_fifty_parts_come_down_to_one(spark, tmp_path):
    longest = spark.sparkContext.accumulator(0)
    calls = spark.sparkContext.accumulator(0)

    def refine(prompt):
        calls.add(1)
        longest.add(max(0, len(prompt) - longest_allowed))
        return "s" + re.search(r"#(\d+)", prompt)[1] + "." if "#" in prompt else prompt[-40:]

    longest_allowed = 100 + 2000  # a part and the question round it
    texts = {"hot": [f"#{i} " + "x" * 90 for i in range(50)], "one": ["short"]}
    got = reduced(spark, texts, refine, str(tmp_path / "m"), part_chars=100, waves=1, digits=1)
    assert got["one"] == ["short"] and len(got["hot"]) == 1 and len(got["hot"][0]) <= 100
    assert longest.value == 0 and 50 < calls.value < 60
    again = calls.value
    assert reduced(spark, texts, refine, str(tmp_path / "m"), part_chars=100, waves=1, digits=1) == got and calls.value == again


def test_failed_parts_keep_their_text(spark, tmp_path):
    def refine(prompt):
        if "#bad" in prompt:
            raise OSError("unreachable")
        return "ok"

    texts = {"e": ["#0" + "x" * 28, "#bad" + "y" * 16, "#2" + "z" * 28], "f": ["#bad" + "q" * 26] * 3}
    got = reduced(spark, texts, refine, str(tmp_path / "m"), part_chars=30)
    assert got == {"e": ["ok\n#bad" + "y" * 16 + "\nok"], "f": texts["f"]}  # three parts of f cannot be shortened


def test_estimates_over_all_parts(spark, tmp_path):
    """An entity that cannot be shortened is asked part by part; the most confident answer counts."""
    rows = spark.createDataFrame([("a", i, "toxic", f"toxic {i} " + "w" * 40) for i in range(4)] + [("b", 9, "toxic", "toxic few")], "dsstox string, o int, heading string, value string")
    entities = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "dsstox string, name string")
    measured = spark.createDataFrame([("m", "M", 0.5, 1.5)], "id string, name string, mg double, ppm double")

    def model(prompt, endpoint):
        seen = re.findall(r"toxic (\d)", prompt)
        return '{"lc50": %s, "confidence": %s}' % ((int(seen[0]) + 1) * 10, {"2": 9}.get(seen[0], 3)) if seen else '{"lc50": 5, "confidence": 1}'

    found = estimate_whole(entities, rows, measured, ["toxic"], ["o"], str, model, str(tmp_path / "m"), part_chars=58, waves=1, digits=1)
    got = {r.dsstox: (r.pred_lc50_4hr_ppm, r.confidence_ppm) for r in found.collect()}
    assert got["a"] == (pytest.approx(1.4771, abs=1e-4), 9.0) and got["b"][1] == 1.0 and got["c"][1] == 1.0
    examples = spark.createDataFrame([("none",)], "examples_text string")
    prompts = whole_prompts(entities, rows, ["toxic"], ["o"], examples, str, str(tmp_path / "p"), part_chars=58, waves=1, digits=1)
    assert {(r.dsstox, r.part) for r in prompts.collect()} >= {("a", 0), ("a", 3), ("b", 0), ("c", 0)}


def test_a_task_makes_python_objects_of_the_rows_in_flight_only(spark):
    asked = spark.range(100, numPartitions=1).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("text"), F.lit(None).cast("string").alias("none"))

    def model(text, none):
        if text.endswith("7"):
            raise ValueError(text)
        return f"{text} {none}"

    answers = inference.infer(asked, "k", ["text", "none"], model, in_flight=3)
    expected = [(i, None, f"ValueError: t{i}") if i % 10 == 7 else (i, f"t{i} None", None) for i in range(100)]
    assert [tuple(r) for r in answers.collect()] == expected
    assert "MapInPandas" not in answers._jdf.queryExecution().executedPlan().toString()  # it makes objects of a whole batch
    assert inference.infer(asked.where("false"), "k", ["text", "none"], model).collect() == []


def test_few_waves_write_no_copy_of_the_requests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inference, "scratch_path", None)
    asked = spark.range(40).select(F.md5(F.col("id").cast("string")).alias("memo_key"), F.col("id").cast("string").alias("text"))
    for hit in (False, True):
        answers = inference.ask_in_waves(asked, ["text"], str.strip, str(tmp_path / "memo"), waves=2, digits=1)
        assert sorted((int(r.result), r.error, r.memo_hit) for r in answers.collect()) == [(i, None, hit) for i in range(40)]
