import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from epochline.llm import packing, queries
from tests.conftest import TESTDATA
from tests.llm.helpers import clashing, docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def places(plan, counts):
    """Sequence and offset of every piece, checked to be whole, without gaps and within the capacity."""
    rows = sorted(plan.rows)
    at, bins = defaultdict(list), defaultdict(list)
    for length, rank, first, per, offset in rows:
        at[length].append((rank, first, per, offset))
    for length, n in counts.items():
        for rank in range(n):
            r, first, per, offset = [x for x in at[length] if x[0] <= rank][-1]
            bins[first + (rank - r) // per].append((offset + (rank - r) % per * length, length))
    for content in bins.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= plan.capacity
    assert len(bins) == plan.bins
    return bins


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 60), max_size=25), st.integers(1, 12))
def test_plans_are_packings(counts, groups):
    plan = packing.plan_packing(counts, 64, groups)
    places(plan, counts)
    total = sum(s * n for s, n in counts.items())
    assert plan.bins <= 2 * -(-total // 64) + 1


def test_knapsack_against_brute_force():
    rnd = random.Random(1)
    for _ in range(50):
        sizes = np.array(sorted(rnd.sample(range(3, 30), 4)))
        worth = np.array([rnd.random() for _ in sizes])
        best = {0: 0.0}
        for room in range(1, 41):
            best[room] = max([best[room - 1]] + [best[room - s] + w for s, w in zip(sizes.tolist(), worth.tolist()) if s <= room])
        taken = packing.knapsack(sizes, worth, 40)
        assert taken @ sizes <= 40 and abs(taken @ worth - best[40]) < 1e-9


@pytest.mark.parametrize("lengths", ["short", "long", "thirds", "few"])
def test_plans_are_tight(lengths):
    rnd = random.Random(2)
    draw = {
        "short": lambda: min(2047, int(rnd.lognormvariate(5.9, 1.0)) + 1),
        "long": lambda: rnd.randrange(600, 2048),
        "thirds": lambda: rnd.choice([683, 682, 1024, 700, 300, 200, 41]),
        "few": lambda: rnd.choice([900, 1148]),
    }[lengths]
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[draw()] += 1
    plan = packing.plan_packing(counts, 2048)
    bins = places(plan, counts)
    bound = -(-sum(s * n for s, n in counts.items()) // 2048)
    if lengths == "few":  # two of 900, or one of each
        bound = max(counts[1148], -(-20_000 // 2))
    if lengths == "long":  # more than half a sequence each: one to a sequence
        bound = max(bound, sum(n for s, n in counts.items() if s > 1024))
    assert len(bins) <= bound * {"short": 1.001, "long": 1.02, "thirds": 1.01, "few": 1.001}[lengths] + 2


def check(rows, got, capacity, end):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = defaultdict(list)
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        want[i].append([ids[a : a + capacity] for a in range(0, len(ids), capacity)])
    expected = sorted(
        (str(i), k, k * capacity, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, copies in want.items() for ps in copies for k, p in enumerate(ps)
    )
    assert sorted((str(r[0]), r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for content in sequences.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_odd_rows(spark):
    rows = [(None, "no id here"), (1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, "long words " * 400), (5, "x" * 3000), (6, "Ünïcode　<|endoftext|> 漢字")]
    for table in (docs(spark, rows), clashing(docs(spark, rows))):
        got = packing.pack_documents(table, PATH, capacity=32, end_id=7, groups=4).collect()
        n = check(rows, got, 32, 7)
        assert n <= -(-sum(r.length for r in got) // 32) + 1
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0


def test_sequences(spark):
    rows = [(i, "some words " * (i % 9)) for i in range(60)]
    packed = packing.pack_documents(docs(spark, rows), PATH, capacity=16, keep_ids=True)
    got = packing.assemble(packed).collect()
    whole = {(r.sequence_id, r.offset): r.ids for r in packed.collect()}
    for r in got:
        assert len(r.ids) == 4 * sum(r.lengths) <= 64
        offset = 0
        for n in r.lengths:
            assert bytes(r.ids[4 * offset : 4 * (offset + n)]) == bytes(whole[r.sequence_id, offset])
            offset += n


def test_query(spark):
    table = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    got = queries.op12_packing(spark, TESTDATA).collect()
    n = check([(r.doc_id, r.text) for r in table.collect()], got, 2048, 0)
    assert n <= 1.01 * sum(r.length for r in got) / 2048 + 2


def test_long_texts_of_many_pieces_are_packed_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "SPLIT_CHARS", 20)
    own = Tokenizer.from_file(PATH)
    texts = [" ".join(f"w{(i * 31 + d) % 977}" for i in range(400)) for d in range(6)]
    expected = set()
    for d, text in enumerate(texts):
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 0], "<u4")
        expected |= {(d, k, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes())) for k, s in enumerate(range(0, len(ids), 512))}
    got = packing.pack_documents(docs(spark, list(enumerate(texts))).coalesce(1), PATH, 512, 0).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == expected
