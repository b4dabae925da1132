import itertools
import random

import numpy as np

from epochline.llm import langid
from tests.llm.helpers import clashing, docs

SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "lich", "ver"], "cc": ["привет", "мир", "дом"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def model(spark, rng):
    rows = [(say(rng, lang, 50), lang) for lang in SYLLABLES for _ in range(20)] + [(None, "aa"), ("text without language", None), ("", "bb")]
    return langid.fit_languages(spark.createDataFrame(rows, "text string, lang string").repartition(3))


def test_held_out_and_mixed_texts(spark):
    rng = random.Random(8)
    known = model(spark, rng)
    assert known.languages == ["aa", "bb", "cc"]
    cyrillic = langid.SCRIPTS.index("cyrillic")
    assert known.allowed[cyrillic].tolist() == [False, False, True]
    rows = [(i, say(rng, lang, 30)) for i, lang in enumerate(list(SYLLABLES) * 5)]
    mixed = say(rng, "aa", 20) + " " + say(rng, "bb", 30)
    rows += [(100, mixed), (101, None), (102, ""), (103, "12 34 !!"), (None, say(rng, "cc", 3)), (104, "ა"), (0, rows[0][1])]
    got = langid.label_languages(clashing(docs(spark, rows)), known).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang == lang and by_id[i].score == 1.0 for i, lang in enumerate(list(SYLLABLES) * 5))
    assert [by_id[i].lang for i in (101, 102, 103)] == ["und"] * 3 and by_id[104].lang in known.languages
    assert [s.lang for s in by_id[100].spans] == ["aa", "bb"] and 0.4 < by_id[100].score < 1
    assert by_id[100].spans[1].end == len(mixed)


def test_only_letters_count(spark):
    known = model(spark, random.Random(8))
    none = ["٣٤", "。。", "× ÷", "१२३", "🙂 — „“", "12,5 %", "\u0301"]
    letters = ["ա", "ა", "𐤀", "ª", "ꙮ", "ﬁ", "٣ ب"]
    got = {r.doc_id: r for r in langid.label_languages(docs(spark, list(enumerate(none + letters))), known).collect()}
    assert [(got[i].lang, got[i].score, got[i].spans) for i in range(len(none))] == [("und", 0.0, [])] * len(none)
    assert all(got[len(none) + i].lang in known.languages for i in range(len(letters)))


def test_a_language_of_any_script_is_learned(spark):
    rng = random.Random(2)
    words = {"hy": ["բարեւ", "աշխարհ", "տուն"], "ka": ["გამარჯობა", "სახლი", "წყალი"], "xx": ["𐤀𐤁𐤂", "𐤃𐤄"], "en": ["house", "water", "world"]}
    rows = [(" ".join(rng.choice(ws) for _ in range(20)), lang) for lang, ws in words.items() for _ in range(10)]
    known = langid.fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    texts = [(i, " ".join(rng.choice(ws) for _ in range(5))) for i, ws in enumerate(words.values())]
    got = {r.doc_id: (r.lang, r.score) for r in langid.label_languages(docs(spark, texts), known).collect()}
    assert got == {i: (lang, 1.0) for i, lang in enumerate(words)}


def test_scripts_by_code_point():
    text = "aé×Ωжա٣ب漢かไ한ა𐤀 ﬁ1"
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    names = [langid.SCRIPTS[s] for s in langid._scripts(data)[at]]
    assert names == ["latin", "latin", "none", "greek", "cyrillic", "armenian", "none", "arabic", "han", "kana", "thai", "hangul", "georgian", "other", "none", "other", "none"]
    assert not langid._scripts(data)[(data & 0xC0) == 0x80].any()


def test_no_languages(spark):
    none = langid.fit_languages(docs(spark, []))
    assert [r.lang for r in langid.label_languages(docs(spark, [(1, "words")]), none).collect()] == ["und"]


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = rng.integers(0, 6, 4)
        first = np.concatenate([[0], np.cumsum(counts)])
        scores = rng.normal(size=(first[-1], 3))
        label = langid.viterbi(scores, first, 0.8)
        for a, b in zip(first, first[1:]):
            value = lambda path: sum(scores[a + i, s] for i, s in enumerate(path)) - 0.8 * sum(x != y for x, y in zip(path, path[1:]))  # noqa: E731, B023
            best = max(value(path) for path in itertools.product(range(3), repeat=b - a))
            assert abs(value(label[a:b]) - best) < 1e-9
