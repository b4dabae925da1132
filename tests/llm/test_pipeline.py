import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from epochline.llm import queries
from tests.conftest import TESTDATA
from tests.llm.helpers import clashing, docs
from tests.llm.test_jaccard import brute as near_brute
from tests.llm.test_repeats import brute as repeats_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_odd_rows(spark):
    rows = [(None, "a text without an id"), (1, None), (2, ""), (3, "plain words of a short text"), (3, "plain words of a short text"), (4, "x " * 20_000), (5, "plain words of a short text")]
    for table in (docs(spark, rows), docs(spark, []), clashing(docs(spark, rows))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, TESTDATA)
            assert out.count() <= len(rows), name
            assert name == "bpe" or out.columns == table.columns


def test_near_copies_keeps_one_of_each_class(spark):
    rows = [(i, f"{i % 3} one two three four five six seven eight nine ten") for i in range(9)] + [(20, None), (21, ""), (None, "alone here")]
    kept = corpus_pipeline.keep_one_of_a_kind(spark, docs(spark, [*rows, rows[0]]), TESTDATA)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "2", "20", "21", "None"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def mixed_rows():
    """Near copies, repeated strings, test items and plain texts."""
    rng = random.Random(12)
    voc = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    base, passage = [say(60) for _ in range(8)], say(30)
    rows = [(i, say(rng.randint(3, 90))) for i in range(30)]
    for i in range(30, 60):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(voc)
        rows.append((i, " ".join(w)))
    rows += [(i, f"{say(10)} {passage} {say(5)}") for i in range(60, 70)]
    return rows + [(70, None), (71, ""), (72, "short one")]


def test_near_copies_against_brute_force(spark):
    rows = mixed_rows()
    component = {key: top for key, _, top in near_brute(rows, 5, 80, 100)}
    kept = {str(r.doc_id) for r in stage("near_copies")(spark, docs(spark, rows), TESTDATA).collect()}
    assert kept == {key for key, top in component.items() if key == top}


def test_repeats_against_brute_force(spark):
    rows = mixed_rows()
    want = {key: (n, rest) for key, (_, n, _, rest) in repeats_brute(rows, 100).items()}
    got = {r.doc_id: r.text for r in stage("repeats")(spark, docs(spark, rows), TESTDATA).collect()}
    for key, text in rows:
        gone, rest = want[key]
        if not gone:
            assert got[key] == text
        elif rest.decode(errors="ignore").strip():
            assert got[key] == rest.decode(errors="ignore")
        else:
            assert key not in got


def test_bpe_against_the_library(spark):
    rows = mixed_rows()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in stage("bpe")(spark, docs(spark, rows), TESTDATA).collect():
        ids = whole.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decontamination_drops_planted_items_alone(spark):
    items = [r.text for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").collect() if r.text and len(r.text.split()) > 12]
    rows = [(i, t) for i, t in mixed_rows() if t]
    planted = [(1000 + k, f"{dict(rows)[k]} {item} {dict(rows)[k + 1]}") for k, item in enumerate(items[:15])]
    kept = {r.doc_id for r in stage("decontaminate")(spark, docs(spark, rows + planted), TESTDATA).collect()}
    assert kept == {i for i, _ in rows}


def test_the_whole_pipeline(spark):
    got = corpus_pipeline.run(spark, TESTDATA)
    n = spark.read.parquet(f"{TESTDATA}/documents.parquet").count()
    assert 0.5 * n < got.count() < n and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_a_query_per_operator():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "decontaminate", "bpe"]


def test_repeats_carry_a_text_once(spark, monkeypatch):
    carried, remove = [], corpus_pipeline.repeats.remove_repeats
    monkeypatch.setattr(corpus_pipeline.repeats, "remove_repeats", lambda df, **how: carried.extend(how["carry"]) or remove(df, **how))
    same = "word " * 40
    rows = [(1, None), (2, ""), (3, f"one {same}"), (4, f"two {same}"), (5, "ñ short"), (None, "z")]
    df = docs(spark, rows).withColumn("no_text", F.lit(7))
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, df, "").collect()}
    assert "text" not in carried
    assert got[1].text is None and got[1].n_chars is None and got[2].text == "" and got[2].n_chars == 0
    assert got[5].text == "ñ short" and got[None].text == "z" and all(r.no_text == 7 for r in got.values())
    assert got[4].text is not None and len(got[4].text) < len(f"two {same}") and got[4].n_chars == len(got[4].text)
