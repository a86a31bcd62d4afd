"""Whole flows on small raw tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from propflow.operators.inference import accepts, apply_codec_once, infer, safe_codec
from propflow.plans.estimates import ENDPOINTS, estimate_entities, evaluated, lookup_rows, question_estimates
from propflow.plans.property_table import property_table
from propflow.plans.sequences import SPECIALS, build_vocabulary, tokenised, training_rows


def markup(*texts):
    return json.dumps({"Name": "n", "Value": {"StringWithMarkup": [{"String": t} for t in texts]}})


@pytest.fixture(scope="module")
def annotations(spark):
    rows = [
        (1, [11], "EPA DSSTox", "Ids", markup("D1")),
        (2, [12], "EPA DSSTox", "Ids", markup("D2")),
        (3, [11], "A", "Acute Toxicity", markup("toxic", "at dose")),
        (4, [11], "A", "Acute Toxicity", json.dumps({"Value": {"Number": [7]}})),
        (5, [11, 12], "A", "Acute Toxicity", markup("toxic twice")),
        (6, [12], "A", "Colour", markup("toxic blue")),
        (7, [13], "A", "Toxicity", markup("toxic without id")),
        (8, [11], "A", "Toxicity Summary", markup("very toxic")),
    ]
    return spark.createDataFrame(rows, "ord int, pub_chem_cid array<bigint>, source_name string, heading string, data string")


def test_property_table(spark, annotations):
    eav = spark.createDataFrame(
        [("11", "PUBCHEM_OPENEYE_CAN_SMILES", "CC"), ("12", "PUBCHEM_OPENEYE_CAN_SMILES", "??"), ("11", "x", "y")],
        "id string, property string, value string",
    )
    measured = spark.createDataFrame([(11, "D1", 0.5, None)], "pub_chem_cid bigint, dsstox_substance_id string, mg double, ppm double")

    def codec(smiles):
        if "?" in smiles:
            raise ValueError(smiles)
        return "".join(f"[{c}]" for c in smiles)

    got = property_table(
        annotations, measured, eav, ["toxicity", "ids"], safe_codec(codec, "string"), {"mg": "MG", "ppm": "PPM"}
    )
    assert sorted((r.property, r.value, r.dsstox_substance_id, tuple(r.symbols_split)) for r in got.collect()) == [
        ("A - Acute Toxicity - ", "7", None, ("[C]", "[C]")),
        ("A - Acute Toxicity - n", "toxic at dose", None, ("[C]", "[C]")),
        ("A - Toxicity Summary - n", "very toxic", None, ("[C]", "[C]")),
        ("EPA DSSTox - Ids - n", "D1", None, ("[C]", "[C]")),
        ("MG", "0.5", "D1", ("[C]", "[C]")),
    ]


def test_estimates_from_annotations_to_metrics(spark, annotations, tmp_path):
    rows = lookup_rows(annotations, "ord")
    assert sorted(r.ord for r in rows.collect()) == [1, 2, 3, 4, 6, 8]
    prompts = spark.sparkContext.accumulator(0)

    def refine(prompt):
        if "compound two" in prompt:
            raise OSError("unreachable")
        return prompt.upper() + "  "

    def model(prompt, endpoint):
        prompts.add(1)
        if "exposure of compound three in both" in prompt:
            return "no json"
        if endpoint == ENDPOINTS[0]:
            return json.dumps({"lc50": 1000.0, "confidence": 7 if "VERY TOXIC" in prompt else 5})
        return json.dumps({"lc50": 0.0, "confidence": 9}) if "exposure of compound two in both" in prompt else json.dumps({"lc50": 10, "confidence": 6})

    entities = spark.createDataFrame(
        [("D1", "compound one"), ("D2", "compound two"), ("D3", "compound three")], "dsstox string, name string"
    )
    measured = spark.createDataFrame(
        [("D1", "compound one", 0.5, 1.5), ("D2", "compound two", 0.1, 0.2)], "id string, name string, mg double, ppm double"
    )
    arguments = (entities, rows, measured, ["toxic"], ["ord"], refine, model, str(tmp_path / "memo"))
    records = estimate_entities(*arguments)
    got = {r.dsstox: r for r in records.collect()}
    assert prompts.value == 6
    assert (got["D1"].pred_lc50_4hr_mg_L, got["D1"].pred_lc50_4hr_ppm) == (0.0, 1.0)
    assert (got["D1"].confidence_mgL, got["D1"].confidence_ppm, got["D1"].prediction_available) == (7.0, 6.0, True)
    assert (got["D2"].pred_lc50_4hr_mg_L, got["D2"].pred_lc50_4hr_ppm, got["D2"].confidence_ppm) == (0.0, None, 0.0)
    assert got["D3"].prediction_available is False
    judged = evaluated(records, measured, "id", ("mg", "ppm"))
    assert [r.dsstox for r in judged["rows"].collect()] == ["D1"]
    overall = {r.unit: r for r in judged["overall"].collect()}
    assert (overall["mg/L"].n, overall["mg/L"].mae, overall["ppm"].mae, overall["ppm"].r2) == (1, 0.5, 0.5, None)
    assert sorted((r.unit, r.threshold) for r in judged["sweep"].collect()) == [
        ("mg/L", 5), ("mg/L", 6), ("mg/L", 7), ("ppm", 5), ("ppm", 6),
    ]
    again = {r.dsstox: tuple(r) for r in estimate_entities(*arguments).collect()}
    assert again == {k: tuple(r) for k, r in got.items()} and prompts.value == 6


def test_question_estimates(spark, tmp_path):
    answers = {"a": 10.0, "b": 0.0, "c": None}

    def model(prompt):
        return json.dumps({"lc50_4hr_mg_L": answers[prompt.split()[-3]], "confidence": 4})

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "a")], "id int, name string")
    got = question_estimates(df, "name", model, str(tmp_path / "memo"), floor=0.1).orderBy("id").collect()
    assert [(r.pred_4_hr_value_mgL_log10, r.CONFIDENCE) for r in got] == [
        (1.0, 4.0), (math.log10(0.1), 4.0), (None, 0.0), (None, 0.0), (1.0, 4.0),
    ]
    assert [bool(r.error) for r in got] == [False, False, False, True, False]


def test_training_rows_do_not_depend_on_partitions(spark):
    rows = [(i, "[C]" * (i % 5 + 1), f"prop {i % 3}", f"positive {i % 4}.0") for i in range(40)]
    rows.append((40, None, "p", "v"))
    df = spark.createDataFrame(rows, "id int, s string, p string, v string")

    def run(parts):
        spread = df.repartition(parts)
        vocabulary = build_vocabulary(spread, "s", "p", "v")
        packed = tokenised(spread, "id", "s", "p", "v", vocabulary)
        return sorted(map(str, training_rows(packed, "id").collect())), {r.symbol: r.idx for r in vocabulary.collect()}

    one, vocabulary = run(1)
    assert run(16) == (one, vocabulary)
    assert len(one) == 40 and sorted(vocabulary.values()) == list(range(len(vocabulary)))
    assert [vocabulary[s] for s in SPECIALS] == [0, 1, 2, 3, 4]
    assert sum("split='test'" in row for row in one) == 4


def test_checks_and_spread_requests(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "id int, t string")

    def check(text):
        return {"ok": True}[text]

    assert [r[0] for r in df.select(accepts(check, F.col("t"))).collect()] == [True, False, False]
    spread = infer(df.where("t is not null"), "id", ["t"], str.upper, tasks=3)
    assert sorted(r.result for r in spread.collect()) == ["BAD", "OK"]
    assert spread.rdd.getNumPartitions() == 3


def test_a_codec_is_asked_once_per_value(spark):
    calls = spark.sparkContext.accumulator(0)

    def codec(text):
        calls.add(1)
        return {"a": 1, "b": 2}[text]

    rows = [(i, ["a", "b", "bad", "", None][i % 5]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(8)
    got = {r.id: (r.n, r.n_failed) for r in apply_codec_once(df, "t", codec, "n", "int").collect()}
    expected = {"a": (1, False), "b": (2, False), "bad": (None, True)}
    assert got == {i: expected.get(t, (None, False)) for i, t in rows} and calls.value == 3
