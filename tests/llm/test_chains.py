import random

import numpy as np

from epochline.llm import chains
from tests.llm.helpers import clashing, docs


def sample():
    rng = random.Random(12)
    voc = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    say = lambda n: [rng.choice(voc) for _ in range(n)]
    shared = [say(80) for _ in range(4)]
    rows, planted = [], {}
    for i in range(40):
        w = say(rng.randint(0, 200))
        if i % 2 == 0:
            passage = list(shared[i % 8 // 2])
            for _ in range(rng.choice([0, 0, 3])):
                passage[rng.randrange(10, 70)] = rng.choice(voc)
            planted[i] = (len(w), len(w) + 80)
            w = [*w, *passage, *say(50)]
        rows.append((i, " ".join(w)))
    return rows, planted


def test_planted_passages(spark):
    rows, planted = sample()
    extra = [(100, None), (101, ""), (102, "a b"), (None, rows[0][1]), (5, rows[5][1])]
    got = chains.repeated_passages(clashing(docs(spark, [*rows, *extra]))).collect()
    found = {r.doc_id: r for r in got if r.doc_id is not None}
    first = {min(i for i in planted if i % 8 == r) for r in (0, 2, 4, 6)}
    assert set(found) == set(planted) - (first - {0})  # the row without an id comes before document 0
    for i, r in found.items():
        if i:
            start, end = planted[i]
            assert abs(r.start - start) <= 20 and abs(r.end - end) <= 20 and r.identity > 0.85, r
    assert found[0].source_id is None and found[0].identity == 1.0


def test_no_rows(spark):
    assert chains.repeated_passages(docs(spark, [])).count() == 0


def test_chain_against_plain_dynamic_programming():
    rng = random.Random(13)
    for _ in range(60):
        links = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randint(1, 25))})
        x, y = [p[0] for p in links], [p[1] for p in links]
        best = []
        for j in range(len(x)):
            befores = [(best[i] + 0.1 * (x[i] + y[i]), i) for i in range(j) if x[i] < x[j] and y[i] < y[j]]
            top = max((b for b, _ in befores), default=None)
            value = 6.0
            if top is not None and top - 0.1 * (x[j] + y[j]) > 0:
                value = max(top - 0.1 * (x[j] + y[j]) + min(6, x[j] - x[i], y[j] - y[i]) for b, i in befores if b == top)
            best.append(value)
        found = chains.chain(x, y, gap_cost=0.1)
        assert sorted(q for _, c in found for q in c) == list(range(len(x)))
        assert all(x[a] < x[b] and y[a] < y[b] for _, c in found for a, b in zip(c, c[1:]))
        assert found[0][0] >= 6.0 and found[0][0] <= max(best) + 5


def test_common_subsequence():
    assert chains.common(np.array([1, 2, 3, 4]), np.array([2, 9, 4])) == 2
    assert chains.common(np.array([]), np.array([1])) == 0


def test_passages_whose_lines_stand_alone_in_earlier_texts(spark):
    rng = random.Random(14)
    voc = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    say = lambda n: [rng.choice(voc) for _ in range(n)]
    rows, wanted = [], {}
    for case in range(12):
        lines = [say(rng.randint(30, 38)) for _ in range(rng.choice([2, 3]))]
        passage = [w for line in lines for w in line]
        for line in lines:
            rows.append((len(rows), " ".join([*say(30), *line, *say(30)])))
        if case % 2:  # the places where lines meet stand alone in earlier texts too
            rows.append((len(rows), " ".join([*say(30), *lines[0][-18:], *lines[1][:18], *say(30)])))
        rows.append((len(rows), " ".join([*say(25), *passage, *say(25)])))
        wanted[len(rows)] = (len(rows) - 1, 25 + 10 * (case % 3), passage)
        rows.append((len(rows), " ".join([*say(25 + 10 * (case % 3)), *passage, *say(25)])))
    got = chains.repeated_passages(clashing(docs(spark, rows))).collect()
    for i, (source, start, passage) in wanted.items():
        found = [r for r in got if r.doc_id == i]
        assert any(r.source_id == source and r.start <= start and r.end >= start + len(passage) for r in found), (i, found)
    # every run of 40 words of an earlier text lies in a passage
    split, seen = {i: t.split() for i, t in rows}, set()
    for i in sorted(split):
        runs = [tuple(split[i][p : p + 40]) for p in range(len(split[i]) - 39)]
        for p, run in enumerate(runs):
            assert run not in seen or any(r.doc_id == i and r.start <= p and r.end >= p + 40 for r in got), (i, p)
        seen.update(runs)


def test_text_that_repeats_itself_is_one_passage(spark):
    rng = random.Random(15)
    say = lambda n: ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(n)]
    rows = [(0, " ".join([*say(50), *(["lo", "la"] * 40), *say(50)])), (1, " ".join([*say(30), *(["lo", "la"] * 150), *say(30)]))]
    got = [r for r in chains.repeated_passages(docs(spark, rows)).collect() if r.doc_id == 1]
    assert len(got) <= 3 and min(r.start for r in got) == 30 and max(r.end for r in got) == 330, got


def test_passages_that_share_a_single_seed(spark):
    rng = random.Random(16)
    say = lambda n: [f"w{rng.randrange(30_000)}" for _ in range(n)]
    rows, planted = [], {}
    for case in range(60):
        passage = say(60)
        if case % 2:  # replaced
            copy = [w if rng.random() > 0.2 else say(1)[0] for w in passage]
        else:  # put in
            copy = [v for w in passage for v in ([w] if rng.random() > 0.2 else [w, *say(1)])]
        equal = chains.common(np.array([hash(w) for w in copy]), np.array([hash(w) for w in passage]))
        rows += [(2 * case, " ".join([*say(60), *passage, *say(60)])), (2 * case + 1, " ".join([*say(70), *copy, *say(70)]))]
        if equal >= 0.7 * max(len(copy), len(passage)):
            planted[2 * case + 1] = len(copy)
    got = chains.repeated_passages(clashing(docs(spark, rows))).collect()
    found = {r.doc_id for r in got if r.doc_id in planted and r.source_id == r.doc_id - 1 and min(r.end, 70 + planted[r.doc_id]) - max(r.start, 70) >= planted[r.doc_id] / 2}
    assert len(planted) > 50 and len(found) >= 0.8 * len(planted), (len(found), len(planted))
    assert {r.doc_id for r in got} <= {2 * case + 1 for case in range(60)}  # clean texts have none


def test_words_around_chains_are_shuffled_once(spark, monkeypatch):
    plans, settle = [], chains.settle
    monkeypatch.setattr(chains, "settle", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or settle(df, name))
    rows, planted = sample()
    frames = [docs(spark, r, 1) for r in (rows, [*rows, *rows, rows[6], rows[6]])]  # rows that repeat an id and its text change nothing
    once, again = ([tuple(r) for r in chains.repeated_passages(df).collect()] for df in frames)
    assert sorted(once) == sorted(again) and len(once) > 10
    assert plans and not any(word in plan for plan in plans for word in ("Distinct", "Deduplicate"))


def test_single_links_are_aligned_as_one_by_one():
    rng = random.Random(17)
    for _ in range(60):
        few = rng.choice([3, 10, 200])
        a = [rng.randrange(few) for _ in range(rng.randint(6, 130))]
        b = [w if rng.random() > 0.2 else rng.randrange(few) for w in a for _ in range(1 if rng.random() > 0.1 else rng.choice([0, 2]))] + [1] * 6
        a, b = np.array(a, np.uint64), np.array(b, np.uint64)
        x, y = (np.array([rng.randint(0, len(v) - 6) for _ in range(20)]) for v in (a, b))
        y[:10] = np.minimum(x[:10], len(b) - 6)
        at = np.array([x, y])
        got, _ = chains.align_all(a, b, at, at, np.full(20, 6), np.tile([[0], [len(a)], [0], [len(b)]], 20), False)
        for q, (u, v) in enumerate(zip(x.tolist(), y.tolist())):
            base, low = max(0, u - chains.MARGIN), max(0, v - chains.MARGIN)
            s, e, t, f, equal = chains.align(a[base : u + 6 + chains.MARGIN], b[low : v + 6 + chains.MARGIN], [u - base], [v - low])
            assert got[:, q].tolist() == [s + base, e + base, t + low, f + low, equal]


def edited(rng, words, share):
    return [w if rng.random() > share else f"new{rng.randrange(10**9)}" for w in words]


def test_passages_within_a_passage_of_another_text(spark):
    rng = random.Random(18)
    say = lambda n: [f"w{rng.randrange(30_000)}" for _ in range(n)]
    rows = []
    for case in range(40):
        passage = say(120)
        middle = edited(rng, passage[30:90], 0.2)  # mostly one seed
        for words in (middle, passage, passage):
            rows.append((len(rows), " ".join([*say(60), *words, *say(60)])))
    got = {(r.doc_id, r.source_id) for r in chains.repeated_passages(docs(spark, rows, 1)).collect()}
    wanted = [3 * case for case in range(40) if (3 * case + 1, 3 * case) in got]
    assert len(wanted) > 20 and all((i + 2, i) in got and (i + 2, i + 1) in got for i in wanted)


def test_copies_that_follow_each_other_are_passages_each(spark):
    rng = random.Random(19)
    say = lambda n: [f"w{rng.randrange(30_000)}" for _ in range(n)]
    rows, near, apart = [], [], []
    for _ in range(40):
        passage = say(45)
        copies = [edited(rng, passage, 0.1) for _ in range(3)]
        rows.append((len(rows), " ".join([*say(60), *passage, *say(60)])))
        for gap, list_ in ((0, near), (150, apart)):
            list_.append(len(rows))
            rows.append((len(rows), " ".join([*say(60), *(w for copy in copies for w in [*copy, *say(gap)]), *say(60)])))
    got = chains.repeated_passages(docs(spark, [r for r in rows if r[0] not in apart], 1)).collect()
    alone = chains.repeated_passages(docs(spark, [r for r in rows if r[0] not in near], 1)).collect()
    found = [{(r.doc_id, (r.start + r.end) // 2 // step) for r in some if r.doc_id in of and r.end - r.start >= 40} for some, of, step in ((got, near, 45), (alone, apart, 195))]
    assert len(found[1]) > 80 and len(found[0]) >= 0.7 * len(found[1]), [len(f) for f in found]
