"""Benchmark decontamination: a BM25 index of test items, searched by every passage of the training texts.

The items are the indexed side and small; the passages are the queries. Weights are divided by what an item
scores against itself, so one threshold holds for all. The search is block-max WAND for many passages at
a time: frequent terms that together stay under the threshold in every segment can't bring one in, so only
the postings of the others are opened; a passage and a segment that meet there are dropped if the block
maxima of the passage's frequent terms can't lift them over it; what is left is scored in full, and then
verified on the word n-grams of question and answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochline.llm.arrow_text import NOT_ALNUM, Words, chunks, small_batches, utf8

#: Words of a passage and of the step to the next; an item's segment is shorter than a passage by a step.
PASSAGE, STEP = 96, 32
SEGMENT = PASSAGE - STEP
#: Postings that share a block maximum.
BLOCK = 64
_MAYBE = 1 << 20
#: Characters of items in one index. More items make more indexes, each of which all passages search.
INDEX_CHARS = 20_000_000


def part_grams(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-grams of a part; of its whole sequence if it is shorter."""
    n = min(n, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j]
    return np.unique(out)


@dataclass
class Index:
    """Segments of items with normalised BM25 weights, by term."""

    ids: list
    #: Per item: n-gram length and n-grams of question and of answer.
    parts: list[tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]]
    item: np.ndarray  # of each segment
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # postings of term t: first[t] to first[t + 1]
    segment: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bound: np.ndarray = field(default_factory=lambda: np.zeros(0))  # greatest weight of a term
    maybe: np.ndarray = field(default_factory=lambda: np.zeros(_MAYBE, bool))  # by the low bits of a hash: whether it can be a term
    block: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # greatest weight of a term in a block of segments


def build_index(items: list[tuple[object, str, str]], n: int, k1: float = 1.2, b: float = 0.75) -> Index:
    """An index of (id, question, answer)."""
    ids, parts, owner, segments = [], [], [], []
    for key, question, answer in items:
        hashes = []
        for text in (question, answer):
            data = np.frombuffer((text or "").encode(), np.uint8)
            hashes.append(Words(data, np.array([0, len(data)]), NOT_ALNUM).hash)
        whole = np.concatenate(hashes)
        if not len(whole):
            continue
        parts.append(tuple((min(n, len(h)), part_grams(h, n)) for h in hashes))
        for a in range(0, len(whole), SEGMENT):
            owner.append(len(ids))
            segments.append(whole[a : a + SEGMENT])
        ids.append(key)
    index = Index(ids, parts, np.array(owner, np.int64))
    if not segments:
        return index
    lengths = np.array([len(s) for s in segments])
    seg = np.repeat(np.arange(len(segments)), lengths)
    pair, tf = np.unique(np.rec.fromarrays([np.concatenate(segments), seg], names="t,s"), return_counts=True)
    term, s = pair["t"], pair["s"]
    index.terms, at, df = np.unique(term, return_inverse=True, return_counts=True)
    index.maybe[index.terms & np.uint64(_MAYBE - 1)] = True
    idf = np.log1p((len(segments) - df + 0.5) / (df + 0.5))[at]
    w = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[s] / lengths.mean()))
    w /= np.bincount(s, w)[s]
    index.first = np.concatenate([[0], np.cumsum(df)])
    index.segment, index.weight = s.astype(np.int64), w
    index.bound = np.maximum.reduceat(w, index.first[:-1])
    index.block = np.zeros((len(index.terms), len(segments) // BLOCK + 1), np.float32)
    np.maximum.at(index.block, (at, s // BLOCK), (w * (1 + 1e-6)).astype(np.float32))
    return index


def essential_terms(index: Index, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which terms can bring an item in, and what each segment gets from the others at most.

    The most frequent terms are set aside as long as no segment gets more than half the threshold from them.
    """
    df = np.diff(index.first)
    of = np.repeat(np.arange(len(df)), df)
    essential = np.ones(len(df), bool)
    rest = np.zeros(int(index.segment.max()) + 1 if len(index.segment) else 0)
    for least in sorted(set(df.tolist()), reverse=True):
        more = rest + np.bincount(index.segment, np.where(df[of] == least, index.weight, 0.0), minlength=len(rest))
        if more.max() > threshold / 2:
            break
        rest, essential[df == least] = more, False
    return essential, rest


def search(index: Index, words: Words, threshold: float, essential: np.ndarray, rest: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, first word, end word, segment, score) of every passage and segment that score at least the threshold."""
    terms, width = index.terms, PASSAGE // STEP
    if not len(terms) or not len(words.hash):
        return
    hit = np.flatnonzero(index.maybe[words.hash & np.uint64(_MAYBE - 1)])
    at = np.minimum(np.searchsorted(terms, words.hash[hit]), len(terms) - 1)
    same = terms[at] == words.hash[hit]
    hit, at = hit[same], at[same]
    stripes = -(-np.diff(words.first) // STEP)
    base = np.concatenate([[0], np.cumsum(stripes)])
    row = words.row[hit]
    pair = np.unique((base[row] + (hit - words.first[row]) // STEP) * len(terms) + at)
    stripe, term = pair // len(terms), pair % len(terms)
    of = np.repeat(np.arange(len(stripes)), stripes)

    # What essential terms give a segment in each passage; a term in several stripes of it counts more than once, which only raises the bound.
    opened = np.flatnonzero(essential[term])
    df = index.first[term[opened] + 1] - index.first[term[opened]]
    posting = np.arange(int(df.sum())) - np.repeat(np.cumsum(df) - df, df) + np.repeat(index.first[term[opened]], df)
    where, segment, weight = np.repeat(stripe[opened], df), index.segment[posting], index.weight[posting]
    begins = np.concatenate([where - k for k in range(width)])
    inside = np.concatenate([(where - k >= 0) & (of[np.maximum(where - k, 0)] == of[where]) for k in range(width)])
    key = (begins * len(rest) + np.tile(segment, width))[inside]
    key, inverse = np.unique(key, return_inverse=True)
    score = np.bincount(inverse, np.tile(weight, width)[inside], minlength=len(key))
    begins, segment = key // len(rest), key % len(rest)
    keep = score + rest[segment] >= threshold - 1e-9
    begins, segment, score = begins[keep], segment[keep], score[keep]

    postings = np.repeat(np.arange(len(terms)), np.diff(index.first)) * len(rest) + index.segment
    first_pair = np.searchsorted(stripe, np.arange(len(of) + 1))
    for lo, hi in zip(*_groups(begins)):
        begin, found = int(begins[lo]), segment[lo:hi]
        text = of[begin]
        end = min(begin + width, base[text + 1])
        mine = np.unique(term[first_pair[begin] : first_pair[end]])
        frequent = mine[~essential[mine]]
        top = index.block[frequent][:, found // BLOCK].sum(axis=0)
        found = found[score[lo:hi] + top >= threshold - 1e-6]
        if not len(found):
            continue
        wanted = mine[:, None] * len(rest) + found[None, :]
        place = np.minimum(np.searchsorted(postings, wanted), len(postings) - 1)
        exact = np.where(postings[place] == wanted, index.weight[place], 0.0).sum(axis=0)
        a = words.first[text] + (begin - base[text]) * STEP
        z = min(a + PASSAGE, words.first[text + 1])
        for s, x in zip(found, exact):
            if x >= threshold:
                yield int(text), int(a), int(z), int(s), float(x)


def _groups(sorted_values: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, int)
    return starts.tolist(), [*starts[1:].tolist(), len(sorted_values)] if len(starts) else []


MATCH = "array<struct<item_id:{id},score:double,question_overlap:double,answer_overlap:double,start:long,end:long>>"


def with_matches(
    df: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    question_col: str = "question",
    answer_col: str = "answer",
    n: int = 3,
    threshold: float = 0.4,
    overlap: float = 0.6,
    matches_col: str = "matches",
) -> DataFrame:
    """The rows of `df` with the test items that they hold, as an array of structs.

    A match has the item, the best score of a passage (1: the item itself), the shares of the question's and
    the answer's word n-grams that the retrieved passages hold, both at least `overlap`, and the bytes from
    the first to the last of these passages. Null and empty texts match nothing; items without words, or with
    neither question nor answer, are found nowhere, and an empty answer counts as held. Repeated rows stay;
    repeated items match each by itself. `matches_col` replaces a column of that name.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.drop(matches_col)
    kind = items.schema[item_col].dataType
    wanted = items.select(F.col(item_col).alias("id"), *(F.coalesce(F.col(c), F.lit("")).alias(c2) for c, c2 in ((question_col, "q"), (answer_col, "a"))))
    size = wanted.agg(F.sum(F.length("q") + F.length("a"))).first()[0] or 0
    blocks = -(-size // INDEX_CHARS) or 1
    schema = f"row {rows.select(F.struct('*').alias('row')).schema['row'].dataType.simpleString()}, found {MATCH.format(id=kind.simpleString())}"
    out = rows.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.array().cast(MATCH.format(id=kind.simpleString())).alias("found"))
    for k in range(blocks):  # a block is bounded by INDEX_CHARS but for a single longer item
        block = wanted.where(F.pmod(F.xxhash64("id", "q"), F.lit(blocks)) == k).orderBy("id", "q", "a").collect()
        index = spark.sparkContext.broadcast(build_index([tuple(r) for r in block], n))
        out = out.mapInArrow(_matcher(index, n, threshold, overlap), schema.replace(", found ", ", text string, found ", 1))
    return out.select("row.*", F.col("found").alias(matches_col))


def _matcher(shared, n: int, threshold: float, overlap: float):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        essential, rest = essential_terms(index, threshold)
        for batch in batches:
            data, off = utf8(batch.column(1))
            found = batch.column(2).to_pylist()
            for a, b in chunks(off, 1 << 20):
                words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a], NOT_ALNUM)
                held: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
                for text, first, end, segment, score in search(index, words, threshold, essential, rest):
                    held.setdefault((text, int(index.item[segment])), []).append((first, end, score))
                for (text, item), spans in held.items():
                    shares = [_share(words.hash, spans, k, grams) for k, grams in index.parts[item]]
                    if min(shares) >= overlap:
                        begin = off[a] - off[a + text]
                        found[a + text].append(
                            {
                                "item_id": index.ids[item],
                                "score": max(s[2] for s in spans),
                                "question_overlap": shares[0],
                                "answer_overlap": shares[1],
                                "start": int(words.start[min(s[0] for s in spans)] + begin),
                                "end": int(words.end[max(s[1] for s in spans) - 1] + begin),
                            }
                        )
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, batch.column(2).type)], ["row", "text", "found"])

    return build


def _share(h: np.ndarray, spans: list[tuple[int, int, float]], k: int, grams: np.ndarray) -> float:
    if not len(grams):
        return 1.0
    here = np.unique(np.concatenate([part_grams(h[a:b], k) for a, b, _ in spans if b - a >= k] or [np.zeros(0, np.uint64)]))
    return float(np.isin(grams, here).mean())


def question_and_answer(items: DataFrame, text_col: str = "text", question_col: str = "question", answer_col: str = "answer") -> DataFrame:
    """Items that are one text: the last sentence of at least three words is the answer; else the last quarter of the words.

    A null or empty text has an empty question and answer. Repeated items stay; other columns are kept, but for those that are
    named like the two that are added.
    """
    text = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    last = F.regexp_extract(text, r"(?s)^.*[.!?\n]\s+(\S+\s+\S+\s+\S.*)$", 1)
    words = F.split(text, r"\s+")
    quarter = F.array_join(F.slice(words, F.size(words) - F.floor(F.size(words) / 4).cast("int") + 1, F.floor(F.size(words) / 4).cast("int")), " ")
    chosen = F.when(last != "", last).otherwise(quarter)
    out = items.withColumn(answer_col, chosen)
    return out.withColumn(question_col, F.expr(f"left(trim(coalesce(`{text_col}`, '')), greatest(0, length(trim(coalesce(`{text_col}`, ''))) - length(`{answer_col}`)))"))


def decontaminate(df: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The rows that hold no test item, with their columns. Settings as for `with_matches`.

    Null and empty texts hold none and stay, as do repeated rows and null ids; a text is searched whole, however long. Columns of any name are kept.
    """
    name = "__matches"
    while name in df.columns:
        name += "_"
    return with_matches(df, items, matches_col=name, **settings).where(F.size(name) == 0).drop(name)
