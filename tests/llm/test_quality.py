import json
import math
import random

from epochline.llm import quality
from tests.llm.helpers import clashing, docs


def sample():
    rng = random.Random(4)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    good = [" ".join(rng.choice(voc) for _ in range(rng.randint(20, 80))) + "." for _ in range(80)]
    bad = [" ".join([rng.choice(voc)] * rng.randint(20, 80)) for _ in range(40)]
    bad += [" ".join(f"{rng.choice(voc).upper()}!!" for _ in range(rng.randint(20, 80))) for _ in range(40)]
    return [(i, t, int(i < 80)) for i, t in enumerate(good + bad)]


def test_held_out_accuracy(spark):
    rows = sample()
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 4] + [(None, 1, 0), (3, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    table = clashing(docs(spark, [(i, t) for i, t, _ in rows]))
    model = quality.fit_quality(table, labels)
    assert 0 < len(model.weights) and "rules" in model.to_json()
    got = {r.doc_id: r.score for r in quality.score_quality(table, model, keep=("n_chars", "label")).collect()}
    assert all((got[i] > 0.5) == (q == 1) for i, _, q in rows if i % 4 == 0)


def test_odd_texts_and_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs(spark, []), empty)
    got = quality.score_quality(docs(spark, [(1, None), (2, ""), (None, " \n"), (4, "x" * 100_000), (4, "x" * 100_000)]), model).collect()
    assert len(got) == 5 and all(r.score == 0.5 for r in got)
    assert quality.score_quality(docs(spark, []), model).count() == 0
    one = quality.fit_quality(docs(spark, [(1, "a")]), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert not one.weights


def test_paths():
    tree = "Tree\n  If (feature 0 <= 3.0)\n   If (feature 0 <= 1.5)\n    Predict: 0.0\n   Else (feature 0 > 1.5)\n    Predict: 1.0\n  Else (feature 0 > 3.0)\n   Predict: 1.0\n"
    name = quality.STATISTICS[0]
    assert [r.conditions for r in quality.paths(tree)] == [((name, False, 3.0),), ((name, False, 1.5),), ((name, False, 3.0), (name, True, 1.5)), ((name, True, 3.0),)]


def test_rules_against_plain_evaluation(spark):
    """Scores of compiled columns against conditions checked one by one."""
    rows = sample()
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs(spark, [(i, t) for i, t, _ in rows]), labels)
    told = json.loads(model.to_json())
    assert any(len(rule["all"]) > 1 for rule in told["rules"])
    texts = [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "! ! !"), (903, "word " * 5000)]
    for r in quality.score_quality(docs(spark, texts), model).collect():
        total = told["bias"]
        for rule in told["rules"]:
            if all(r[name] > t if over else r[name] <= t for name, over, t in rule["all"]):
                total += rule["weight"]
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-12
