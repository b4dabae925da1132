import random

import pytest

from epochline.llm import components, jaccard
from tests.llm.helpers import clashing, docs, words


def brute(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return sorted((str(r[0]), len(sets[i]), str(least.get(top(i)) if sets[i] else r[0])) for i, r in enumerate(rows))


def sample(seed, n=160):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(300)] + ["É", "été", "THE", "the"]
    base = [[rng.choice(voc) for _ in range(rng.choice([2, 3, 5, 20, 60, 200]))] for _ in range(15)]
    rows = [(900, None), (901, ""), (902, "  \n"), (None, "a b c d e f")]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            j = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[j] = rng.choice(voc)
            elif rng.random() < 0.5 and len(w) > 1:
                del w[j]
            else:
                w.insert(j, rng.choice(voc))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return [*rows, rows[10], (10, "another text of the same id here")]


@pytest.mark.parametrize("k,num,page,sample_of,tried", [(4, 85, 128, 16, 3), (5, 80, 4, 1, 1), (4, 85, 2, 2, 0)])
def test_against_brute_force(spark, monkeypatch, k, num, page, sample_of, tried):
    monkeypatch.setattr(jaccard, "PAGE", page)
    monkeypatch.setattr(jaccard, "DEALT", 3 * page)
    monkeypatch.setattr(jaccard, "SAMPLE", sample_of)
    monkeypatch.setattr(jaccard, "TRIED", tried)
    rows = sample(num)
    got = jaccard.similar_classes(clashing(docs(spark, rows)), k=k, num=num).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component)) for r in got) == brute(rows, k, num, 100)


def test_empty_table(spark):
    assert jaccard.similar_classes(docs(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a long, b long")
    assert {(r.node, r.label) for r in components.connected_components(edges).collect()} == {(i, 0) for i in range(21)} | {(30, 30), (31, 30)}
