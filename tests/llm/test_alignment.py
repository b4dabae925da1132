import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from epochline.llm import alignment, queries
from epochline.llm.alignment import Fragment, Groups, Pairs, Tokens, compose, fragment
from tests.conftest import TESTDATA
from tests.llm.helpers import clashing, docs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PAIRS = Pairs(100, 100)


class Plain:
    """Both tokenizers over whole texts, and groups by going along both."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [x for x in range(256) if x not in shown]
        self.byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(other)}

    def groups(self, text):
        if not text:
            return None
        whole = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        spell_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        spell_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in b)]
        if b"".join(spell_a) != whole or b"".join(spell_b) != whole:
            return None
        ends_a, ends_b = np.cumsum([len(x) for x in spell_a]).tolist(), np.cumsum([len(x) for x in spell_b]).tolist()
        out, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
            out.append((a[x:p], b[y:q]))
            x, y = p, q
        return out


def brute(rows):
    """Result rows of the contract, by document."""
    plain = Plain()
    found = [(i, plain.groups(t)) for i, t in rows]
    count = Counter((g[0][-1], g[1][-1]) for _, gs in found for g in gs or [])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, gs in found:
        links = [(g[0][-1], g[1][-1]) for g in gs or []]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs or [])
        sha = hashlib.sha256(text.encode()).hexdigest() if gs else ""
        sums = (sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links))
        out.append((str(i), sum(len(a) for a, _ in gs or []), sum(len(b) for _, b in gs or []), len(links), len(links), *sums, sha))
    return sorted(out)


def plain_rows(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


sides = st.lists(st.tuples(st.integers(0, 99), st.integers(1, 4)), min_size=1, max_size=25)


def tokens(a, b):
    size = max(sum(n for _, n in a), sum(n for _, n in b))
    a, b = ([*x, (7, size - sum(n for _, n in x))] if sum(n for _, n in x) < size else x for x in (a, b))
    ids = lambda x: np.array([i for i, _ in x], np.int64)
    ends = lambda x: np.cumsum(np.array([n for _, n in x], np.int64))
    return Tokens(ids(a), ends(a), ids(b), ends(b))


def seen(f: Fragment):
    return [x.tolist() for t in (f.head, f.tail) for x in t.parts()], f.closed, f.first, f.last


@settings(max_examples=300, deadline=None)
@given(sides, sides, st.data())
def test_composition_is_associative_and_whole(a, b, data):
    t = tokens(a, b)
    cuts_a = sorted(data.draw(st.lists(st.integers(0, len(t.a)), min_size=3, max_size=3)))
    cuts_b = sorted(data.draw(st.lists(st.integers(0, len(t.b)), min_size=3, max_size=3)))
    pieces = []
    for i, j, x, y in zip([0, *cuts_a], [*cuts_a, len(t.a)], [0, *cuts_b], [*cuts_b, len(t.b)]):
        pieces.append(fragment(Tokens(t.a[i:j], t.a_end[i:j], t.b[x:y], t.b_end[x:y]), PAIRS))
    one, two, three, four = pieces
    c = lambda x, y: compose(x, y, PAIRS)
    want = seen(fragment(t, PAIRS))
    assert seen(c(c(c(one, two), three), four)) == want
    assert seen(c(one, c(two, c(three, four)))) == want
    assert seen(c(c(one, two), c(three, four))) == want
    nothing = Fragment(alignment.NONE, Groups(), alignment.NONE)
    assert seen(c(nothing, fragment(t, PAIRS))) == want == seen(c(fragment(t, PAIRS), nothing))


ODD = [
    (None, "no id here"), (1, None), (2, ""), (3, "the same words"), (3, "the same words"), (4, " two  blanks\n\n and\tmore \n"), (5, "it's we'll 'quoted' 12abc34,x-y"),
    (6, "漢字仮名交じり文。ｶﾀｶﾅ"), (7, "<s> </s> <0x41> <|endoftext|> <unk>"), (8, "a ▁ b"), (9, "nul \x00 \x1c \x85   ᠎ x y 　z"), (10, " "), (11, "é ﬁ ٣٤ 🙂 \U0001f468‍\U0001f469"),
    (12, "x" * 700), (13, "word " * 300 + "end"), (14, "0123456789abcdef" * 60), (15, "▁" + "w " * 400), (16, "漢字" * 200 + "ab, cd " * 50), (17, "'" * 90 + " a  b" * 60),
]


def test_odd_rows_against_brute_force(spark):
    want = brute(ODD)
    for split in (1 << 14, 60, 7):
        assert plain_rows(alignment.align_documents(docs(spark, ODD), A, B, split=split)) == want
    assert plain_rows(alignment.align_documents(clashing(docs(spark, ODD)), A, B, split=200)) == want
    assert alignment.align_documents(docs(spark, []), A, B).count() == 0


def test_random_texts_in_ranges():
    rnd, own, plain = random.Random(4), alignment.both(A, B), Plain()
    for _ in range(150):
        text = "".join(rnd.choice(["a", "bc", "The", " ", " ", "  ", "\n", "'s", "'", "12", ".", ",\"", "漢", "é", "-", "_", "xyz", " of"]) for _ in range(rnd.randrange(1, 120)))
        gs = plain.groups(text)
        want = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs)
        assert own.groups(text).text == want
        parts = []
        for _, x, a, y, b in own.ranges(text, rnd.choice([1, 5, 20])):
            parts.append(fragment(own.tokens(own.tokens_a(a), x, own.inner_b(b), y), own.pairs))
        while len(parts) > 1:
            parts = [compose(*parts[i : i + 2], own.pairs) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        assert alignment.finish(parts[0], own.pairs).text == want


def test_rare_pairs_are_joined(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HOT", 8)
    rows = [(i, f"the cat number {i} and the dog") for i in range(30)]
    assert plain_rows(alignment.align_documents(docs(spark, rows), A, B)) == brute(rows)


def test_tokens_without_bytes():
    t = Tokens(np.array([1, 2, 3]), np.array([2, 2, 5]), np.array([4, 5]), np.array([2, 5]))
    whole = alignment.finish(fragment(t, PAIRS), PAIRS)
    assert whole.text == "1,2|4;3|5" and np.frombuffer(whole.links, "<u4").tolist() == [104, 204, 305]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()]
    got = queries.op13_alignment(spark, TESTDATA)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert plain_rows(got) == brute(rows)


def test_later_stages_have_the_room_of_the_words():
    own = alignment.both(A, B)
    first = own.groups("some words of a text")
    own.words.older = {"kept": None}
    assert len(own.words)
    alignment.forget_words()
    assert not own.words and not own.words.older
    assert own.groups("some words of a text") == first
