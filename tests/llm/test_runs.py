import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from epochline.llm import queries, runs
from tests.llm.helpers import WORD, clashing, docs


def brute(words, exponent=4, least=6):
    """All runs by trying every period at every start."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                out.append((i, j - i + q, q))
            i = j + 1 if j > i else i + 1
    smallest = []
    for s, length, q in out:
        part = words[s : s + length]
        if not any(all(part[k] == part[k + d] for k in range(length - d)) for d in range(1, q)):
            smallest.append((s, length, q))
    return sorted(smallest)


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40) | st.lists(st.sampled_from("abc"), max_size=30), max_size=4), st.sampled_from([(2, 2), (3, 5), (4, 6)]))
def test_runs_of_small_alphabets(texts, rule):
    h = np.array([ord(w) for t in texts for w in t], np.uint64)
    row = np.array([i for i, t in enumerate(texts) for _ in t], np.int64)
    first, want = 0, []
    for t in texts:
        want += [(first + s, length, q) for s, length, q in brute(t, *rule)]
        first += len(t)
    assert runs.find_runs(h, row, *rule) == sorted(want)


def test_runs_within_longer_texts():
    rnd = random.Random(5)
    for _ in range(40):
        words = []
        while len(words) < 300:
            unit = [rnd.randrange(30) for _ in range(rnd.randrange(1, 12))]
            words += unit * rnd.choice([1, 1, 2, 5, 9]) + unit[: rnd.randrange(len(unit))]
        h, row = np.array(words, np.uint64), np.zeros(len(words), np.int64)
        assert runs.find_runs(h, row, 4, 6) == brute(words)


def test_odd_rows(spark):
    rows = [(None, "x " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "go " * 6 + "on"), (4, "go " * 6 + "on"), (5, "go " * 5), (6, "A a " * 3), (7, "é x\x0by " * 70_000)]
    for table in (docs(spark, rows), clashing(docs(spark, rows))):
        got = sorted((str(r[0]), r[1], [tuple(x) for x in r[2]], r[3]) for r in runs.periodic_runs(table).collect())
        want = [("1", 0, [], ""), ("2", 0, [], ""), ("3", 0, [], ""), *[("4", 7, [(0, 6, 1)], "go on")] * 2, ("5", 5, [], "go go go go go")]
        want += [("6", 6, [], "A a A a A a"), ("7", 140_000, [(0, 140_000, 2)], "é x y"), ("None", 9, [(0, 9, 1)], "x")]
        assert got == want
    assert runs.periodic_runs(docs(spark, [])).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, "  ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 3) for _ in range(rnd.randrange(80)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "tick " * 40 + "tock")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    some = 0
    for i, text in rows:
        words = planted(i, text)
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        some += len(found)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (best[1] and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
    assert some > 5
