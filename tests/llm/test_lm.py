import math
import random
from collections import Counter

import numpy as np
import pytest

from epochline.llm import lm
from tests.llm.helpers import clashing, docs, words


def sample():
    rng = random.Random(9)
    voc = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(voc, k=rng.randint(0, 60)))) for i in range(150)]
    return [*rows, (500, None), (501, ""), (None, "w1 W1 É"), (3, rows[3][1]), (3, "another text of that id")]


def test_exact_counts(spark):
    rows = sample()
    train = [t for i, t in rows if i is None or i % 5]
    model = lm.fit_model(docs(spark, [(i, t) for i, t in rows if i is None or i % 5]))
    counts = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    assert (model.n_tokens, model.n_words) == (n, v)
    for top in (0.05, 0.0):
        got = lm.score_texts(clashing(docs(spark, rows)), model, top_share=top).collect()
        want = sorted(
            (str(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6))
            for i, t in rows
        )
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)


def test_scores_by_probes_here_and_there(spark):
    rows = sample()
    model = lm.fit_model(docs(spark, rows))
    here = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm.score_texts(docs(spark, rows), model).collect())
    there = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm.score_texts(docs(spark, rows), model, resident=0).collect())
    assert here == there
    pairs, single = Counter(), Counter()
    for _, t in rows:
        w = ["<", *words(t), ">"]
        pairs.update(zip(w, w[1:]))
        single.update(w)
    level = lambda c: int(math.log2(c)) + 1 if c else 0
    size = sum(single.values()) - single["<"]
    exact = {}
    for i, t in rows:
        w = ["<", *words(t), ">"]
        args = [np.array([f(p) for p in zip(w, w[1:])]) for f in (lambda p: level(pairs[p]), lambda p: level(single[p[0]]), lambda p: level(single[p[1]]))]
        exact.setdefault(str(i), []).append(lm.pair_logs(*args, size, len(single) - 1).sum())
    assert sum(min(abs(s - x) for x in exact[i]) > 0.02 * abs(s) + 0.3 for i, _, s in here) <= len(here) // 20  # but for false hits


def test_empty_tables(spark):
    model = lm.fit_model(docs(spark, []))
    got = lm.score_texts(docs(spark, [(1, "a b")]), model).first()
    assert (got.n_tokens, got.n_known) == (3, 0) and got.base_score == pytest.approx(0.0) and got.score <= 0
    assert lm.score_texts(docs(spark, []), lm.fit_model(docs(spark, [(1, "a")]))).count() == 0


def test_filter_has_no_false_misses():
    rng = np.random.default_rng(3)
    key = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    count = rng.integers(1, 500, 5000)
    probe = lm.Filter({0: lm.build_segment(key, count)}, 1)
    assert (probe.levels(key) >= lm.level_of(count)).all()
    assert (probe.levels(key) > lm.level_of(count)).mean() < 0.06
    assert (probe.levels(rng.integers(0, 2**63, 5000, dtype=np.uint64)) > 0).mean() < 0.06


def test_probes_go_to_the_segments_many_to_a_row(spark, monkeypatch):
    rng = random.Random(23)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(200))) for i in range(200)] + [(7, "twice"), (7, "twice"), (None, None)]
    df = docs(spark, rows)
    model, sent, kind = lm.fit_model(df), [], type(df)
    sort = kind.sortWithinPartitions
    monkeypatch.setattr(kind, "sortWithinPartitions", lambda self, *c: sent.append(self.count()) or sort(self, *c))
    there = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.score_texts(df, model, resident=0).collect())
    assert sent and sum(sent) < 40_000 / 10
    assert there == sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.score_texts(df, model).collect())
    assert len(there) == len(rows)
