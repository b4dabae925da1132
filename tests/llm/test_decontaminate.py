import random

import numpy as np

from epochline.llm import decontaminate as d
from epochline.llm.arrow_text import NOT_ALNUM, Words
from tests.llm.helpers import clashing, docs


def sample():
    rng = random.Random(6)
    voc = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(i, say(rng.randint(8, 40)) + ". " + say(rng.randint(4, 90)) + ".") for i in range(40)]
    rows = []
    for i in range(120):
        text = say(rng.randint(0, 400))
        if i % 4 == 0:
            text += " " + items[i % 40][1].upper().replace(".", "!") + " " + say(100)
        rows.append((i, text))
    return items, rows


def test_planted_items(spark):
    items, rows = sample()
    table = spark.createDataFrame([*items, (None, "item without an id of six words"), (77, None), (78, "")], "item_id long, text string")
    split = d.question_and_answer(table)
    found = d.with_matches(clashing(docs(spark, [*rows, (500, None), (501, ""), (None, items[3][1]), (0, rows[0][1])])), split)
    got = sorted((str(r.doc_id), sorted(m.item_id for m in r.matches)) for r in found.where("size(matches) > 0").collect())
    assert got == sorted([(str(i), [i % 40]) for i in range(0, 120, 4)] + [("None", [3]), ("0", [0])])
    assert found.columns.count("matches") == 1
    clean = d.decontaminate(docs(spark, rows), split)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows if i % 4} and clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert d.decontaminate(docs(spark, rows), table.limit(0).selectExpr("item_id", "text AS question", "text AS answer")).count() == len(rows)
    assert d.decontaminate(docs(spark, []), split).count() == 0
    named = d.decontaminate(docs(spark, rows[:3]).selectExpr("*", "1 AS __matches"), split)
    assert named.columns[-1] == "__matches" and [r[0] for r in named.select("__matches").collect()] == [1, 1]


def test_several_indexes(spark, monkeypatch):
    items, rows = sample()
    split = d.question_and_answer(spark.createDataFrame(items, "item_id long, text string"))
    want = {(r.doc_id, m.item_id) for r in d.with_matches(docs(spark, rows), split).collect() for m in r.matches}
    monkeypatch.setattr(d, "INDEX_CHARS", 3000)
    assert {(r.doc_id, m.item_id) for r in d.with_matches(docs(spark, rows), split).collect() for m in r.matches} == want


def test_search_finds_all_above_the_threshold():
    """Against scoring every segment for every passage."""
    items, rows = sample()
    index = d.build_index([(i, t[: len(t) // 2], t[len(t) // 2 :]) for i, t in items], 3)
    texts = [t.encode() for _, t in rows]
    words = Words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), NOT_ALNUM)
    for threshold in (0.1, 0.25, 0.5):
        got = {(r, a, s): x for r, a, _, s, x in d.search(index, words, threshold, *d.essential_terms(index, threshold))}
        want = {}
        of = np.repeat(np.arange(len(index.terms)), np.diff(index.first))
        for row in range(len(rows)):
            for a in range(words.first[row], words.first[row + 1], d.STEP):
                here = np.isin(index.terms, words.hash[a : min(a + d.PASSAGE, words.first[row + 1])])
                score = np.bincount(index.segment, index.weight * here[of])
                want |= {(row, a, int(s)): score[s] for s in np.flatnonzero(score >= threshold)}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
