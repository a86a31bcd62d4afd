"""Hard negatives, collocations and language models against brute force, on edge rows and on held-out rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from propflow.llm import collocations, language_id, negatives
from propflow.llm.queries import ORACLE, QUERIES
from tools.oracle import compare, connect

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n string, g string, sums string"
LONG = " ".join(f"wort{i % 977}x und" for i in range(30_000))


@pytest.fixture(scope="module")
def edge(spark):
    """Null, empty, blank, short, repeated and very long texts, null ids and languages, clashing columns."""
    texts = [None, "", " \n\t", "one two", "one two", "1234 ?!", LONG, "Ünïcödé 漢字 текст 😀 𠀀𠀁"]
    rows = [(i, t, "en" if i % 2 else "de", "s", 1, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [(None, "one two three", "en", None, None, None, None, None), (30, "one two three", None, "s", 1, "x", "y", "z"), rows[3]]
    return spark.createDataFrame(rows, SCHEMA)


# ---- hard negatives


def brute_negatives(rows, anchors, positives=5, wanted=5, low=80, high=100):
    out = set()
    vectors = {i: (label, np.array(v, dtype=object)) for i, label, v in rows}
    width = max((len(v) for _, v in vectors.values()), default=0)
    vectors = {i: (label, np.pad(v, (0, width - len(v)))) for i, (label, v) in vectors.items()}
    for a in anchors:
        label, v = vectors[a]
        scores = sorted(((-int(v @ w) if width else 0, i) for i, (_, w) in vectors.items() if i != a))
        own = [(-s, i) for s, i in scores if vectors[i][0] == label][:positives]
        for p, pid in own:
            fits = [(-s, i) for s, i in scores if vectors[i][0] != label and low * p <= 100 * -s <= high * p][:wanted]
            out |= {(a, pid, k, i, p, s) for k, (s, i) in enumerate(fits, 1)}
    return out


@pytest.mark.parametrize(("clusters", "first_rows"), [(1, 4096), (4, 30)])
def test_negatives_equal_brute_force(spark, clusters, first_rows):
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(6, 12)) * 40
    vectors = np.floor(centres[draw.integers(0, 6, 900)] + draw.normal(size=(900, 12)) * 25).astype(int)
    vectors[100:400] = vectors[100]  # a third of the rows are one vector
    rows = [(i, int(draw.integers(0, 4)), v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id bigint, label int, v array<bigint>")
    found = negatives.hard_negatives(df, df.where("id % 30 = 0"), clusters=clusters, first_rows=first_rows)
    assert {tuple(r) for r in found.collect()} == brute_negatives(rows, range(0, 900, 30))


def test_certified_members_leave_early(spark, monkeypatch):
    """Tight clusters: the walk ends well before the lists do."""
    draw = np.random.default_rng(3)
    centres = np.eye(8) * 1000
    vectors = np.floor(centres[np.arange(4000) % 8] + draw.normal(size=(4000, 8)) * 8).astype(int)
    rows = [(i, i // 8 % 2, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id bigint, label int, v array<int>")
    lists = negatives.Lists(*[d.withColumn("label", F.col("label").cast("long")).withColumn("id", F.col("id")) for d in (df, df.where("id % 200 = 0"))], clusters=8, first_rows=600)
    seen = spark.sparkContext.accumulator(0)

    class Counted(negatives.Positives):
        def __call__(self, members, active, scores, labels, ids, need):
            seen.add(scores.size)
            return super().__call__(members, active, scores, labels, ids, need)

    def same(members, state):
        if state is None:
            return members.withColumn("need", F.lit(float("-inf")))
        reached = state.groupBy("anchor").agg(F.when(F.count(F.lit(1)) >= 5, F.min("score").cast("double")).alias("need"))
        return members.join(reached, F.col("id") == F.col("anchor"), "left").drop("anchor").na.fill(float("-inf"), ["need"])

    lists.walk(Counted(), same, None, 5).collect()
    assert 0 < seen.value < 20 * 4000 / 3


def test_negatives_of_edge_rows(spark):
    kind = "id bigint, label int, v array<bigint>, norm string, slot string"
    rows = [
        (0, 1, [3, 4]), (1, 1, [3, 4]), (2, 1, [3]), (3, 2, [3, 4]), (4, 2, [0, 0]), (5, 2, []), (6, None, [3, 4]), (7, 2, None),
        (8, 2, [None, 4]), (None, 2, [3, 4]), (9, 2, [1 << 40, -(1 << 40)]), (10, 2, [3, 4]), (10, 1, [0, 0]), (11, 2, [2, 4]),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], kind)
    clean = [(0, 1, [3, 4]), (1, 1, [3, 4]), (2, 1, [3]), (3, 2, [3, 4]), (4, 2, [0, 0]), (5, 2, []), (9, 2, [1 << 26, -(1 << 26)]), (10, 2, [3, 4]), (11, 2, [2, 4])]
    found = {tuple(r) for r in negatives.hard_negatives(df, df.where("id in (0, 2, 4, 5, 6, 9)")).collect()}
    assert found == brute_negatives(clean, [0, 2, 4, 5, 9])
    none = df.where("false")
    assert negatives.hard_negatives(none, none).collect() == [] == negatives.hard_negatives(df, none).collect()


# ---- collocations


def brute_collocations(docs, support, most, inside, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in found.items():
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside_longer = any(
                len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()
            )
            if not inside_longer:
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrases_of(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


@pytest.mark.parametrize(("shards", "support", "most"), [(4, 10, 3), (3, 4, 4)])
def test_collocations_equal_brute_force(spark, monkeypatch, shards, support, most):
    monkeypatch.setattr(collocations, "LEAST_BITS", 6)  # unlike phrases share bits
    draw = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)] + ["Été", "ÉTÉ", "x.y", "don't", "Wort"]
    weights = 1 / np.arange(1, len(words) + 1)
    docs = []
    for i in range(300):
        text = "".join(w + str(draw.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n"], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])) for w in draw.choice(words, 60, p=weights / weights.sum()))
        docs.append((text, ["en", "de", None][i % 3] if i < 200 else "en"))
    df = spark.createDataFrame([(i if i % 7 else None, *d) for i, d in enumerate(docs)], "doc_id bigint, text string, lang string").repartition(5)
    found = phrases_of(df, shards=shards, support=support, most_words=most, top=40)
    assert found == brute_collocations(docs, support, most, 50, 40)


def test_collocations_of_edge_rows(edge):
    rows = [(r.text, r.lang) for r in edge.collect()]
    found = phrases_of(edge, support=2)
    assert found == brute_collocations(rows, 2, 3, 50, 2000) and found
    assert phrases_of(edge.where("false")) == [] == phrases_of(edge.where("text is null"))


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_019
    counts = spark.createDataFrame(
        [("en", "a", 1, big + 7), ("en", "b", 1, big + 1), ("en", "a b", 2, big)], "lang string, phrase string, words int, f bigint"
    )
    totals = spark.createDataFrame([("en", 10 * big)], "lang string, n bigint")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a, **k: (counts, totals))
    row = collocations.collocations(spark.createDataFrame([], "doc_id bigint, text string, lang string")).first()
    assert row.score == 1_000_000 * big * big // ((big + 7) * (big + 1))


def test_given_tables_equal_sql(spark):
    duck = connect(SF)
    for name in ("op11_anchor_lists", "op12_son_collocations"):
        assert compare(QUERIES[name](spark, SF), duck, ORACLE[name]) == []


# ---- languages


def brute_models(docs):
    """Log chance of a text under interpolated Kneser-Ney models of order 4, straight from the definition."""
    def symbols(text):
        out = []
        for c in text or "":
            kind = __import__("unicodedata").category(c)[0]
            out.append(ord(c.lower()[0]) if kind in "LM" else 1)
        kept = [s for i, s in enumerate(out) if s != 1 or (i > 0 and out[i - 1] != 1)]
        return kept

    raw = defaultdict(Counter)
    for text, lang in docs:
        s = symbols(text)
        if lang is None or not any(c.isalpha() for c in text or ""):
            continue
        s = [2, 2, 2, *s, 3]
        raw[lang].update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    counts = {lang: {4: c} for lang, c in raw.items()}
    for levels in counts.values():
        for k in (3, 2, 1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
    size = len({g for levels in counts.values() for g in levels[1]}) + 1
    tables = {}
    for lang, levels in counts.items():
        for k, c in levels.items():
            n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            total, kinds = Counter(), Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            tables[lang, k] = (c, d, total, kinds)

    def chance(lang, gram):
        if not gram:
            return 1 / size
        c, d, total, kinds = tables[lang, len(gram)]
        lower = chance(lang, gram[1:]) if len(gram) > 1 else 1 / size
        h = gram[:-1]
        if not total[h]:
            return lower
        return max(c[gram] - d, 0) / total[h] + d * kinds[h] / total[h] * lower

    def score(lang, text):
        s = [2, 2, 2, *symbols(text), 3]
        return sum(math.log(chance(lang, tuple(s[i : i + 4]))) for i in range(len(s) - 3)), len(s) - 3

    return sorted(counts), score


TEXTS = [
    ("the cat sat on the mat, and the dog ran", "en"), ("a dog and a cat", "en"), ("Der Hund lief über die Straße", "de"),
    ("die katze und der hund", "de"), ("1234", "de"), (None, "en"), ("", "en"), ("le chien", None),
]


def test_models_equal_brute_force_by_either_way(spark):
    rows = [(i, *r) for i, r in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model, floor = language_id.train(df)
    langs, score = brute_models(TEXTS)
    assert sorted(floor) == langs
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["the hund", "straße und mat", "xyz", "a", "Ünï 漢字 dog"])], "id int, text string")
    for model_rows in (1 << 20, 0):  # weights in the tasks, and joined
        for r in language_id.language_sums(asked, model, langs, model_rows).join(asked, "id").collect():
            for i, lang in enumerate(langs):
                logp, n = score(lang, r.text)
                assert n == r.n and r.sums[i] + n * floor[lang] == pytest.approx(logp, rel=1e-4)


def test_languages_of_held_out_rows(spark):
    found = {r.doc_id: r for r in QUERIES["op13_kneser_ney_languages"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", language_id.fold(F.col("doc_id")).alias("fold")).collect()
    held = [r for r in docs if r.fold == 0]
    assert len(found) == len(docs) and {r.doc_id for r in held} == {i for i, f in found.items() if f.held_out}
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.99 * len(held)
    assert sum(found[r.doc_id].accepted for r in held) >= 0.95 * len(held)
    assert all(0 <= f.score <= 1 for f in found.values())


def test_held_out_languages_and_ids_change_nothing(spark):
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet").select("doc_id", "text", "lang")
    blank = docs.withColumn("lang", F.when(language_id.fold(F.col("doc_id")) != 0, F.col("lang")))
    def verdicts(d):
        return {r.doc_id: tuple(r) for r in language_id.predict_languages(d).collect()}

    assert verdicts(docs) == verdicts(blank)


def test_other_scripts_and_noise_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**9, "съешь же ещё этих мягких французских булок " * 20, None), (10**9 + 5, "zxq kjw vvbq xkcd " * 40, None)], docs.schema)
    found = {r.doc_id: r for r in language_id.predict_languages(docs.unionByName(odd)).where("doc_id >= 1000000000").collect()}
    assert len(found) == 2 and not any(r.accepted for r in found.values())


def test_languages_of_edge_rows(edge):
    found = language_id.predict_languages(edge).collect()
    assert len(found) == edge.count()
    by_id = {r.doc_id: r for r in found}
    for i in (0, 1, 2, 5):
        assert by_id[i].lang_pred == "und" and by_id[i].score == 0 and not by_id[i].accepted
    assert by_id[3].lang_pred in ("en", "de") and by_id[None].held_out is False
    assert language_id.predict_languages(edge.where("false")).collect() == []
    unlabelled = language_id.predict_languages(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"} and len(unlabelled) == edge.count()


def test_shares_never_fall():
    cells = [(0, 0), (10, 5), (4, 4), (6, 3), (0, 0), (10, 10)]
    shares = language_id.rising(cells)
    assert len(shares) == len(cells) and shares == sorted(shares) and shares[-1] > 0.9
