import hashlib
import random
import re
from collections import Counter

import pytest

from epochline.llm import merkle, neighbours
from tests.llm.helpers import clashing, docs


def sample():
    rng = random.Random(10)
    voc = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return [(i, "\n".join(" ".join(rng.choice(voc) for _ in range(rng.randint(3, 20))) + "." for _ in range(rng.randint(1, 12)))) for i in range(0, 90, 3)]


def flat_likeness(a, b):
    """Likeness from all marks at once, without a tree."""
    if a.split("|")[0] == b.split("|")[0]:
        return 1.0
    marks = [Counter(m for p in x.replace("|", ",").split(",") if "=" in p for m in re.findall("........", p.split("=")[1])) for x in (a, b)]
    total = sum(marks[0].values()) + sum(marks[1].values())
    return min(2 * sum((marks[0] & marks[1]).values()) / total, 1 - 1e-9) if marks[0] and marks[1] else 0.0


def test_edits_by_the_next_text(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RANGE", 4)
    rows = [*sample(), (1, None), (2, ""), (5, "x"), (None, "no id"), (200, "y" * 50_000)]
    got = {r.doc_id: r for r in merkle.compare_edits(clashing(docs(spark, rows))).collect()}
    order = [*sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]), rows[-2]]
    for (key, text), (_, following) in zip(order, [*order[1:], order[0]]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[key]
        assert (r.n_chars, r.edited_text) == (len(text), edited), key
        assert r.fingerprint == merkle.fingerprint(text) and r.edited_fingerprint == merkle.fingerprint(edited)
        assert r.near_edited == merkle.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == merkle.likeness(r.fingerprint, merkle.fingerprint(following))
        assert (r.near_edited == 1) == (edited == text)
        for print_, other, near in ((r.fingerprint, r.edited_fingerprint, r.near_edited), (r.fingerprint, merkle.fingerprint(following), r.near_next)):
            assert near == flat_likeness(print_, other)
        assert (r.changed, r.changed_edited) == merkle.changed_paragraphs(r.fingerprint, r.edited_fingerprint)
        lines, changed_lines = text.split("\n"), edited.split("\n")
        assert [x for k, x in enumerate(lines) if k not in set(r.changed)] == [x for k, x in enumerate(changed_lines) if k not in set(r.changed_edited)]
    long = [got[k] for k, t in sample() if len(t) > 300]
    assert sum(r.near_edited > 0.25 > r.near_next for r in long) >= 0.9 * len(long)


def test_one_row_repeats_and_no_rows(spark):
    one = merkle.compare_edits(docs(spark, [(1, "abcd")])).first()
    assert (one.edited_text, one.near_next) == ("abab", 1.0)
    same = merkle.compare_edits(docs(spark, [(1, "a b"), (1, "a b"), (None, None), (None, None)])).collect()
    assert len(same) == 4
    assert merkle.compare_edits(docs(spark, [])).count() == 0
    prints = [r.fingerprint for r in merkle.fingerprints(docs(spark, [(1, "a\n\nb"), (2, "a\n\nb"), (3, "a\nb"), (4, None), (5, "")])).orderBy("doc_id").collect()]
    assert prints[0] == prints[1] != prints[2] and prints[3] == prints[4]


def test_differing_branches_locate_edits():
    lines = [f"paragraph number {i} {hashlib.md5(str(i).encode()).hexdigest()}" for i in range(60)]
    other = [*lines]
    other[17] = "something else"
    del other[40]
    a, b = (merkle.fingerprint("\n".join(x)) for x in (lines, other))
    assert merkle.changed_paragraphs(a, b) == ([17, 40], [17])
    assert merkle.changed_paragraphs(a, a) == ([], [])


def test_copies_and_moves_are_located():
    found = lambda x, y: merkle.changed_paragraphs(merkle.fingerprint(x), merkle.fingerprint(y))
    assert found("one line\none line", "one line") == ([1], [])
    a, b = found("x\nx\ny", "x\ny\nx")
    assert len(a) == len(b) == 1
    rng = random.Random(4)
    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(1, 8))] for _ in range(2))
        a, b = found("\n".join(x), "\n".join(y))
        assert [v for k, v in enumerate(x) if k not in a] == [v for k, v in enumerate(y) if k not in b]
        assert bool(a or b) == (x != y)


def test_ids_that_have_no_order(spark):
    with pytest.raises(TypeError, match="numeric"):
        merkle.compare_edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
