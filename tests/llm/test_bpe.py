import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from epochline.llm import bpe
from tests.llm.helpers import clashing, docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_unsplit_runs_by_halves(whole):
    rng = random.Random(1)
    parts = ["a", "b", "the", "E", "é", "é", "!", "'", "'s", "1", "<|endoftext|>", "中", "가", "\U0001f600", "'re", "-", "ß", "\x1c", "　"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 300)))
        own = bpe.codec(PATH, rng.choice([4, 7, 16, 50]))
        assert own.unsplit(text).ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_pieces_are_joined_as_a_tree(whole):
    rng = random.Random(3)
    own = bpe.codec(PATH, 16)
    for _ in range(60):
        text = "".join(rng.choice(["ab", "the", " ", "é", "!", "'s", "\n", "xyzxyzxyzxyzxyz", "漢字", "<|endoftext|>"]) for _ in range(rng.randint(20, 150)))
        cut = [text[a : a + 25] for a in range(0, len(text), 25)]
        level, words = [], []
        for k, x in enumerate(cut):
            ws = bpe.parts(x)
            level.append(bpe.Piece(own.unsplit(ws[0]), own.unsplit(ws[-1]) if len(ws) > 1 else None, k))
            words.append((2 * k + 1, np.frombuffer(own.encode([" ".join(ws[1:-1])])[0], "<u4") if len(ws) > 2 else []))
        while len(level) > 1:
            joined = []
            for i in range(0, len(level), 2):
                if i + 1 == len(level):
                    joined.append(level[i])
                    continue
                piece, word = bpe.join_pieces(own, level[i], level[i + 1])
                joined.append(piece)
                words += [word] if word else []
            level = joined
        words += [(0, level[0].head.ids)] + ([(2 * level[0].tail_at + 2, level[0].tail.ids)] if level[0].tail else [])
        ids = [int(x) for _, w in sorted(words, key=lambda w: w[0]) for x in w]
        assert ids == whole.encode(text, add_special_tokens=False).ids, text


def test_tables(spark, whole, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcde 'é!\n") for _ in range(3000)), "x" * 3000 + "yz" * 900, None, "", " ", "ab" * 4000, "Hello<|endoftext|>World", "ab" * 4000]
    rows = [*enumerate(texts), (None, "null id"), (6, texts[6])]
    got = bpe.round_trip(clashing(docs(spark, rows)), PATH, leaf_chars=64, split_chars=700).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = whole.encode(("null id" if r.doc_id is None else texts[r.doc_id]) or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == whole.decode(ids, skip_special_tokens=False)
    for fan in (2, 50):
        monkeypatch.setattr(bpe, "FAN", fan)
        small = bpe.encode_texts(docs(spark, rows), PATH, leaf_chars=64, split_chars=300).collect()
        assert sorted((str(r.doc_id), bytes(r.ids)) for r in small) == sorted((str(r.doc_id), bytes(r.ids)) for r in got)
    only = bpe.decode_ids(bpe.encode_texts(docs(spark, [(1, "some words")]), PATH), PATH).first()
    assert only.decoded == whole.decode(whole.encode("some words", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.round_trip(docs(spark, []), PATH).count() == 0


def test_more_pieces_than_are_encoded_together(spark, whole):
    texts = [" ".join(f"w{(i * 31 + d) % 977}" for i in range(400)) for d in range(6)]
    rows = docs(spark, list(enumerate(texts))).coalesce(1)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode_texts(rows, PATH, split_chars=20).collect()}
    assert got == {d: whole.encode(text, add_special_tokens=False).ids for d, text in enumerate(texts)}


def test_plain_words_are_encoded_by_the_model_alone(whole, monkeypatch):
    rng = random.Random(4)
    own = bpe.Codec(PATH)
    signs = [chr(c) for c in (*range(128), *range(160, 256))] + ["'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "e\u0301", "\u0130", "The", " ", " "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    asked, ids = [], own.plain.ids
    monkeypatch.setattr(own.plain, "ids", lambda words: asked.extend(words) or ids(words))
    for text, got in zip(texts, own.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    assert len(asked) > 300 and not any("|endoftext|" in w for w in asked)
