"""Language identification with labelled spans for mixed texts.

The script of a word, told by the ranges of its characters, narrows the languages it can be in. Byte
trigrams score the word in each of these, and a Viterbi pass with a penalty per switch labels the words of
the whole text, so that a span changes language only where its words insist.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochline.llm.arrow_text import Words, chunks, small_batches, utf8

#: Hashed trigrams; the model has so many numbers per language, however large the corpus is.
BUCKETS = 1 << 16
UNKNOWN = "und"
#: Ranges of code points by script. Letters outside of them are one more script, and only letters count.
SCRIPT_RANGES = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("latin", 0xFF21, 0xFF5A), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F),
    ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF),
    ("kana", 0x3040, 0x30FF), ("kana", 0xFF66, 0xFF9F), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x2FA1F),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
)
SCRIPTS = ["none", "other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]


@cache
def _script_table() -> np.ndarray:
    """The script of every code point: 0 for all that is no letter (Unicode category L)."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    table = letter.astype(np.uint8)
    for name, low, high in SCRIPT_RANGES:
        table[low : high + 1] = np.where(letter[low : high + 1], SCRIPTS.index(name), 0)
    return table


def _scripts(data: np.ndarray) -> np.ndarray:
    """The script of the character that begins at each byte; 0 elsewhere."""
    table = _script_table()
    out = np.where(data < 0x80, table[data], 0).astype(np.uint8)
    at = np.flatnonzero(data >= 0xC2)
    if len(at):
        b = data[np.minimum(at[:, None] + np.arange(4), len(data) - 1)].astype(np.int64)
        two = (b[:, 0] & 0x1F) << 6 | b[:, 1] & 0x3F
        three = (b[:, 0] & 0x0F) << 12 | (b[:, 1] & 0x3F) << 6 | b[:, 2] & 0x3F
        four = (b[:, 0] & 0x07) << 18 | (b[:, 1] & 0x3F) << 12 | (b[:, 2] & 0x3F) << 6 | b[:, 3] & 0x3F
        out[at] = table[np.where(b[:, 0] < 0xE0, two, np.where(b[:, 0] < 0xF0, three, four))]
    return out


_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32
#: A language is no candidate for a script that fewer than this share of its words have.
RARE_SCRIPT = 0.001


def _features(data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, the trigram bucket at each byte, and the script of each word."""
    words = Words(data, off)
    folded = _FOLD[data]
    folded[words.space[data]] = 32
    padded = np.concatenate([[32], folded, [32]])
    edge = np.zeros(len(data) + 2, bool)  # nothing crosses from text to text
    edge[off[:-1]] = True
    left = np.where(edge[: len(data)], 32, padded[:-2])
    ends = np.zeros(len(data) + 1, bool)
    ends[off[1:]] = True
    right = np.where(ends[1:], 32, padded[2:])
    code = (left << 16) | (folded << 8) | right
    bucket = ((code * 0x9E3779B1) >> 13) & (BUCKETS - 1)
    script = np.maximum.reduceat(_scripts(data), words.start) if len(words.start) else np.zeros(0, np.uint8)
    return words, bucket, script


@dataclass
class LanguageModel:
    languages: list[str]
    #: Log probability per bucket and language.
    trigrams: np.ndarray
    #: Whether a language is a candidate for a script.
    allowed: np.ndarray


def fit_languages(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Trigram and script counts over all rows with a language; rows without one, and texts without words, teach nothing."""
    small_batches(df.sparkSession)
    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            names, of = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True) if batch.num_rows else ([], [])
            total = np.zeros((len(names), BUCKETS + len(SCRIPTS)), np.int64)
            for a, b in chunks(off, 1 << 20):
                words, bucket, script = _features(data[off[a] : off[b]], off[a : b + 1] - off[a])
                own = np.repeat(of[a:b], np.diff(off[a : b + 1]))
                solid = ~words.space[data[off[a] : off[b]]]
                total += np.bincount(own[solid] * total.shape[1] + bucket[solid], minlength=total.size).reshape(total.shape)
                total += np.bincount(of[a:b][words.row] * total.shape[1] + BUCKETS + script, minlength=total.size).reshape(total.shape)
            lang, slot = np.nonzero(total)
            yield pa.record_batch(
                [pa.array([str(names[i]) for i in lang], pa.string()), pa.array(slot.astype(np.int32)), pa.array(total[lang, slot])], ["lang", "slot", "n"]
            )

    counts = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most BUCKETS and a few rows per language
    names = sorted(set(found.column("lang").to_pylist()))
    at = np.searchsorted(names, found.column("lang").to_pylist()) if names else np.zeros(0, int)
    table = np.zeros((len(names), BUCKETS + len(SCRIPTS)))
    table[at, found.column("slot").to_numpy()] = found.column("n").to_numpy()
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    log = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    allowed = (share >= RARE_SCRIPT).T
    allowed[~allowed.any(axis=1)] = True
    allowed[0] = True
    return LanguageModel(names, np.ascontiguousarray(log.T.astype(np.float32)), allowed)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word, for the texts whose words are first[i] to first[i + 1]: sum of scores less `penalty` per switch.

    All texts go forward together, a word at a time; ties go to staying, then to the lower label.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, length = first[:-1][order], counts[order]
    states = scores.shape[1]
    back = np.zeros(scores.shape, np.uint8 if states < 256 else np.uint16)
    own = np.arange(states, dtype=back.dtype)
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), "left")  # texts with more than t words
    value = np.zeros((len(order), states), scores.dtype)
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        v = value[:n]
        best = v.argmax(axis=1)
        jump = v[np.arange(n), best][:, None] - penalty
        stay = v >= jump
        back[at] = np.where(stay, own, best[:, None])
        value[:n] = np.maximum(v, jump) + scores[at]
    label = np.zeros(len(scores), np.int64)
    state = value.argmax(axis=1) if len(order) else np.zeros(0, np.int64)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        label[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return label


def label_languages(
    df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0
) -> DataFrame:
    """(id, lang, score, spans) per row.

    `spans` are (start, end, lang) in bytes, each of words of one language; `lang` is the one whose words with
    letters have most bytes, and `score` its share of those. A text that is null or has no letter is "und"
    with score 0 and no spans; so is every text if the model knows no language. Repeated rows stay.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers per language
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            data, off = utf8(batch.column(1))
            count = batch.num_rows
            lang, score, spans = [UNKNOWN] * count, [0.0] * count, [[] for _ in range(count)]
            if known.languages:
                parts, scores = [], []
                for a, b in chunks(off, 1 << 19):
                    words, bucket, script = _features(data[off[a] : off[b]], off[a : b + 1] - off[a])
                    gained = known.trigrams[bucket]
                    gained[words.space[data[off[a] : off[b]]]] = 0
                    summed = np.add.reduceat(gained, words.start, axis=0) if len(words.start) else np.zeros((0, len(known.languages)), np.float32)
                    summed[~known.allowed[script]] -= 50.0
                    summed[script == 0] = 0.0  # no letters: no opinion
                    parts.append((words.start + off[a], words.end + off[a], words.row + a, script))
                    scores.append(summed)
                if parts:
                    start, end, row, script = (np.concatenate(x) for x in zip(*parts))
                    first = np.searchsorted(row, np.arange(count + 1))
                    label = viterbi(np.concatenate(scores), first, penalty)
                    size = np.where(script > 0, end - start, 0)
                    votes = np.bincount(row * len(known.languages) + label, size, minlength=count * len(known.languages)).reshape(count, -1)
                    change = np.ones(len(row), bool)
                    change[1:] = (row[1:] != row[:-1]) | (label[1:] != label[:-1])
                    opens = np.flatnonzero(change)
                    closes = np.append(opens[1:], len(row)) - 1 if len(opens) else opens
                    for s, e in zip(opens.tolist(), closes.tolist()):
                        base = off[row[s]]
                        spans[row[s]].append({"start": int(start[s] - base), "end": int(end[e] - base), "lang": known.languages[label[s]]})
                    total = votes.sum(axis=1)
                    for x in range(count):
                        if total[x] > 0:
                            best = int(votes[x].argmax())
                            lang[x], score[x] = known.languages[best], float(votes[x, best] / total[x])
                        else:
                            spans[x] = []
            yield pa.record_batch([batch.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(spans, span)], ["id", "lang", "score", "spans"])

    out = rows.mapInArrow(build, f"id {kind}, lang string, score double, spans array<struct<start:long,end:long,lang:string>>")
    return out.withColumnRenamed("id", id_col)
