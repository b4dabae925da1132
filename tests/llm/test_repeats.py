import random

import pytest

from epochline.llm import repeats
from tests.llm.helpers import clashing, docs


def brute(rows, length):
    """By id: bytes, bytes removed, removed runs, and the rest."""
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0])):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            part = raw[p : p + length]
            if part in seen:
                gone[p : p + length] = [True] * length
            seen.add(part)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[key] = (len(raw), sum(gone), runs, bytes(c for c, g in zip(raw, gone) if not g))
    return out


def sample(seed):
    rng = random.Random(seed)
    voc = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    base = [" ".join(rng.choice(voc) for _ in range(120)) for _ in range(6)]
    rows = [(None, base[0]), (1, None), (2, ""), (3, "a" * 700), (4, "ab" * 300), (5, base[1][:99])]
    for i in range(6, 50):
        text = ""
        for _ in range(rng.randint(1, 4)):
            x = rng.choice(base)
            a = rng.randint(0, len(x))
            text += x[a : a + rng.choice([50, 99, 100, 101, 130, 200, 400])]
            text += rng.choice(["", "x", "a" * rng.randint(0, 300), " ".join(rng.choice(voc) for _ in range(20))])
        rows.append((i, text))
    return [*rows, (60, rows[20][1]), (61, rows[20][1]), (61, rows[20][1])]


@pytest.mark.parametrize("length,part", [(100, 1 << 18), (100, 400), (20, 150)])
def test_against_brute_force(spark, monkeypatch, length, part):
    monkeypatch.setattr(repeats, "SLICE", part)
    rows = sample(length + part)
    want = brute(rows, length)
    got = repeats.remove_repeats(clashing(docs(spark, rows)), length=length).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id
        assert sum(s["end"] - s["start"] for s in r.removed) == r.n_removed


def test_empty_table_and_text_output(spark):
    assert repeats.remove_repeats(docs(spark, [])).count() == 0
    text = "".join(f"é{i}" for i in range(60))
    got = {r.doc_id: r.kept for r in repeats.remove_repeats(docs(spark, [(1, text), (2, "y" + text + "é")]), as_text=True, carry=("lang",)).collect()}
    assert got == {1: text, 2: "yé"}
