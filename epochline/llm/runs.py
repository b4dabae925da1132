"""Periodic runs of words, found by uniting suffix classes in the order of decreasing common prefixes.

The suffixes of a text are sorted by prefix doubling; neighbours in that order have a longest common prefix.
From the greatest prefix down, neighbours are united, Kruskal's way: a class then holds the positions whose
suffixes agree in so many words, as an ordered set. Two positions that become neighbours within such a set, at
a distance that the prefix spans often enough, seed a run. Neighbours of a set have no third position between
them, so the distance is the smallest period; the prefix tells where the run ends, and only the seed that no
word before it continues is kept, which tells where it begins.

Texts are handled where they lie, many to a batch: words are 64-bit hashes, sorting is done on whole arrays, and
only the classes that can seed a run are united one by one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochline.llm.arrow_text import BYTE, Words, chunks, mix, small_batches, utf8

U64 = np.uint64
RUN = "struct<start:long,length:long,period:long>"


def least_overlap(exponent: int, least: int) -> int:
    """Words that two places of a run, a period apart, agree in at least."""
    return min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1))


def _repeated(h: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """Rows in which some stretch of `size` words occurs twice."""
    n = len(h) - size + 1
    if n < 2:
        return np.zeros(0, np.int64)
    key = mix(row[:n].astype(np.uint64) + U64(0x9E3779B97F4A7C15))
    for j in range(size):
        key = mix(key * U64(3) + h[j : j + n])
    key, row = key[row[:n] == row[size - 1 :]], row[:n][row[:n] == row[size - 1 :]]
    order = np.argsort(key, kind="stable")
    key = key[order]
    return np.unique(row[order[1:][key[1:] == key[:-1]]])


def suffix_order(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, common, word): the suffixes of all rows in order, the words each shares with the one before it in the
    same row, and per position a number that equal words of a row have in common.

    Prefixes of 1, 2, 4, ... words are ranked; a rank is the place of the first of its class, so classes are refined
    in place and positions that stand alone are left out of later rounds.
    """
    n = len(h)
    order = np.lexsort((h, row))
    new = np.ones(n, bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, size = [rank.copy()], 1
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        at = np.flatnonzero(~alone)  # places in the order whose class has several positions
        if not len(at):
            break
        who = order[at]
        old, after = rank[who], rank[np.minimum(who + size, n)]
        turn = np.lexsort((after, old))
        who, old, after = who[turn], old[turn], after[turn]
        order[at] = who
        split = np.ones(len(at), bool)
        split[1:] = (old[1:] != old[:-1]) | (after[1:] != after[:-1])
        new[at] = split
        rank[who] = np.maximum.accumulate(np.where(split, at, 0))
        levels.append(rank.copy())
        size *= 2
    common = np.zeros(n, np.int64)
    a, b, c = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + c, n)] == levels[k][np.minimum(b + c, n)]
        c[same] += 1 << k
    common[1:] = c
    return order, common, levels[0]


def _hopeful(order: np.ndarray, common: np.ndarray, overlap: int, exponent: int) -> Iterator[tuple[int, int]]:
    """Ranges of the order, of classes that agree in `overlap` words, in which two positions lie near enough to seed a run."""
    joined = np.flatnonzero(common >= overlap)
    if not len(joined):
        return
    first = joined[np.concatenate([[True], np.diff(joined) > 1])] - 1
    last = joined[np.concatenate([np.diff(joined) > 1, [True]])]
    group = np.repeat(np.arange(len(first)), last - first + 1)
    at = _ranges(first, last)
    turn = np.lexsort((order[at], group))
    gap = np.full(len(at), np.iinfo(np.int64).max)
    where = order[at][turn]
    gap[1:] = np.where(group[1:] == group[:-1], np.diff(where), gap[1:])
    begins = np.searchsorted(group, np.arange(len(first)))
    nearest = np.minimum.reduceat(gap, begins)
    inner = common[at].copy()
    inner[begins] = 0
    longest = np.maximum.reduceat(inner, begins)
    for g in np.flatnonzero((exponent - 1) * nearest.astype(np.float64) <= longest):
        yield int(first[g]), int(last[g])


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    sizes = last - first + 1
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


def _unite(order: list[int], common: list[int], exponent: int) -> Iterator[tuple[int, int, int]]:
    """(position, next position, words shared) of pairs that become neighbours of a class, by decreasing common prefix.

    `order` are the positions of one class in suffix order, `common` the words that each shares with the one before.
    """
    parent = list(range(len(order)))
    sets: list[list[int]] = [[p] for p in order]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    turns = sorted(range(1, len(order)), key=lambda x: -common[x])
    at = 0
    while at < len(turns):
        level, fresh = common[turns[at]], []
        while at < len(turns) and common[turns[at]] == level:
            x, y = find(turns[at] - 1), find(turns[at])
            at += 1
            if len(sets[x]) < len(sets[y]):
                x, y = y, x
            big, small = sets[x], sets[y]
            if len(small) * 8 > len(big):
                here = set(small)
                big = sorted(big + small)  # two runs in order: merged in one pass
                fresh += [(u, v, x) for u, v in zip(big, big[1:]) if (u in here) != (v in here)]
            else:
                put = None
                for p in small:
                    k = bisect_left(big, p)
                    if k and big[k - 1] != put:  # two of the small set have been neighbours before
                        fresh.append((big[k - 1], p, x))
                    if k < len(big):
                        fresh.append((p, big[k], x))
                    big.insert(k, p)
                    put = p
            sets[x], sets[y], parent[y] = big, [], x
        for u, v, x in fresh:
            if (exponent - 1) * (v - u) <= level:
                whole = sets[find(x)]  # others of the same prefix may have come between
                if whole[bisect_left(whole, u) + 1] == v:
                    yield u, v, level


def find_runs(h: np.ndarray, row: np.ndarray, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` words and `exponent` periods, each within one row.

    `h` are hashes of words and `row` the ascending number of the text of each; starts count from the first word of all.
    """
    overlap = least_overlap(exponent, least)
    chosen = np.isin(row, _repeated(h, row, overlap))
    at = np.flatnonzero(chosen)
    if not len(at):
        return []
    order, common, word = suffix_order(h[at], row[at])
    word = word.tolist()
    found = set()
    for a, b in _hopeful(order, common, overlap, exponent):
        for p, q, shared in _unite(order[a : b + 1].tolist(), common[a : b + 1].tolist(), exponent):
            d = q - p
            if shared + d >= max(least, exponent * d) and not (p and word[p - 1] == word[q - 1]):
                found.add((int(at[p]), shared + d, d))
    return sorted(found)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """(id, n_words, runs, collapsed) per row.

    `runs` are the stretches of words whose smallest period q fits at least `exponent` times, of at least `least`
    words, that no neighbouring word continues, as (start, length, period) in that order; `collapsed` is the text
    without the words that a run has after its first q, joined by one space. `exponent` is 2 or more. Words are
    `[^\\x20\\x09-\\x0D]+`, capitals differ from small letters, and equal words are those with equal 64-bit hashes.

    Null and empty texts and those without a word have no runs and an empty `collapsed`. Repeated rows and null
    ids stay as they are. A text is handled in one task, in some 100 bytes a word; nothing is shuffled. Other columns
    are not looked at.
    """
    if exponent < 2 or least < 1:
        raise ValueError("a run has at least two periods and one word")
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for a, b in chunks(off, 1 << 22):
                yield part(batch.column(0).slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a])

    def part(ids: pa.Array, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        words = Words(data, off, values=BYTE)
        first = words.first
        runs: list[list] = [[] for _ in range(len(ids))]
        gone = np.zeros(len(words.hash) + 1, np.int64)
        for start, length, period in find_runs(words.hash, words.row, exponent, least):
            r = int(words.row[start])
            runs[r].append((start - int(first[r]), length, period))
            gone[start + period] += 1
            gone[start + length] -= 1
        kept = np.cumsum(gone)[:-1] == 0
        raw, texts = data.tobytes(), []
        for r in range(len(ids)):
            own = raw[off[r] : off[r + 1]].split()  # bytes are split at ASCII white space
            if runs[r]:
                own = [w for w, k in zip(own, kept[first[r] : first[r + 1]].tolist()) if k]
            texts.append(b" ".join(own))
        out = pa.array([[dict(zip(("start", "length", "period"), x)) for x in sorted(xs, key=lambda x: (x[0], x[2]))] for xs in runs], RUNS)
        return pa.record_batch(
            [ids, pa.array(np.diff(first), pa.int64()), out, pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"]
        )

    return rows.mapInArrow(search, f"id {kind}, n_words long, runs array<{RUN}>, collapsed string").withColumnRenamed("id", id_col)


RUNS = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
