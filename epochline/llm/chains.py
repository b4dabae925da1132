"""Fuzzy repeated passages by collinear chaining.

Texts share seeds: k-word shingles that are the least of a window. Each seed is linked to the first text
that has it, so a seed that thousands of texts share makes one link per text. The links of a text to an
earlier one are chained: a Fenwick tree over positions in the earlier text gives the best chain that a link
can go on, less a cost for the words in between. Chains are then aligned on the words themselves.

The first holders of the seeds of a passage may be several texts that share only pieces of it. A second round
therefore links whole stretches of as many words as a passage has at least, each to the first text that has all
of it. Only stretches whose seeds all stand in other texts too, and which no passage of several links covers, ask.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochline.llm.arrow_text import U64, Words, chunks, mix, signed, small_batches, utf8
from epochline.session import release, settle

#: Words of a seed, seeds of a window, cost per word of a gap on either side.
K, WINDOW, GAP_COST = 6, 12, 0.03
#: Words around a chain in which the alignment may go on (from there on further, where a single link has no other to go on from), and what a word costs there that is replaced, missing or put in; an equal one gains 1.
MARGIN, DIFFERENT = 48, 0.6


def _least(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at least k words: the first word of the least shingle of the window that begins at each, whether the window is within one text, and the least shingles of shorter texts."""
    n = len(words.hash)
    out = _seed_hashes(words, np.arange(n - k + 1), k)
    inside = words.row[: n - k + 1] == words.row[k - 1 :]
    keyed = (out & ~U64(0xFFFFFF)) | np.arange(len(out), dtype=np.uint64)
    keyed[~inside] = U64(2**64 - 1)
    counts = np.diff(words.first)
    few = np.flatnonzero((counts >= k) & (counts < k + window - 1))
    short = np.array([int(keyed[words.first[x] : words.first[x + 1] - k + 1].min() & U64(0xFFFFFF)) for x in few], np.int64)
    least, whole = np.zeros(0, np.int64), np.zeros(0, bool)
    if len(keyed) >= window:
        least, w = keyed, 1
        while 2 * w <= window:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        if w < window:
            least = np.minimum(least[: w - window], least[window - w :])
        whole = inside[: len(least)] & inside[window - 1 :] & (words.row[: len(least)] == words.row[window - 1 : window - 1 + len(least)])
        least = np.where(whole, least & U64(0xFFFFFF), 0).astype(np.int64)
    return least, whole, short


def seeds(words: Words, k: int = K, window: int = WINDOW) -> np.ndarray:
    """First words of the k-word shingles that are the least of a window; of a text with fewer shingles, the least of all."""
    if len(words.hash) < k:
        return np.zeros(0, np.int64)
    least, whole, short = _least(words, k, window)
    return np.unique(np.concatenate([short, least[whole]]))


def _seed_hashes(words: Words, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = mix(out + words.hash[at + j] * U64(2 * j + 3))
    return out


_SEEDS = ["seed", "id", "tie", "pos", "sid", "stie", "spos"]


def _find_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of every text. A seed that a text of smaller id in the batch has too is linked to that one here and needn't be sent."""
    for batch in batches:
        data, off = utf8(batch.column(2))
        ids, tie = batch.column(0), np.asarray(batch.column(1))
        parts = []
        for a, b in chunks(off, 1 << 20):
            words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a])
            at = seeds(words)
            parts.append((_seed_hashes(words, at, K), words.row[at] + a, at - words.first[words.row[at]]))
        if not parts:
            continue
        yield from _tell(*(np.concatenate(x) for x in zip(*parts)), ids, tie)


def _tell(seed: np.ndarray, row: np.ndarray, pos: np.ndarray, ids: pa.Array, tie: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The places of each seed in the first text of a batch that has it, to be linked elsewhere, and the links of its other texts to the first place."""
    rank = pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    order = np.lexsort((pos, tie[row], rank[row], seed))
    seed, row, pos = seed[order], row[order], pos[order]
    new = np.ones(len(seed), bool)
    new[1:] = seed[1:] != seed[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(seed)), 0))
    other = ~new & ((rank[row] != rank[row[head]]) | (tie[row] != tie[row[head]]))
    own = ~other
    n = int(own.sum())
    yield pa.record_batch(
        [signed(seed[own]), ids.take(pa.array(row[own])), pa.array(tie[row[own]]), pa.array(pos[own]), pa.nulls(n, ids.type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
        _SEEDS,
    )
    to = head[other]
    spread = mix(seed[other] + row[other].astype(np.uint64))  # linked already: goes to any task
    yield pa.record_batch(
        [signed(spread), ids.take(pa.array(row[other])), pa.array(tie[row[other]]), pa.array(pos[other]), ids.take(pa.array(row[to])), pa.array(tie[row[to]]), pa.array(pos[to])],
        _SEEDS,
    )
    to = np.unique(to)
    spread = mix(seed[to] + row[to].astype(np.uint64))
    yield pa.record_batch([signed(spread), ids.take(pa.array(row[to])), pa.array(tie[row[to]]), pa.array(pos[to]), *_held(len(to), ids.type)], _SEEDS)


def _held(n: int, kind: pa.DataType) -> list[pa.Array]:
    """In place of a link, for the first text of a seed: others have it too."""
    return [pa.nulls(n, kind), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, -1))]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (seed, id, tie, pos): each seed of a text with its first place in another, earlier text, and that place as held. Holds one row."""
    head = None
    for batch in batches:
        seed = np.asarray(batch.column(0))
        if not len(seed):
            continue
        linked = ~np.asarray(batch.column(6).is_null())
        open_ = np.flatnonzero(~linked)
        yield batch.select([1, 2, 3, 4, 5, 6]).filter(pa.array(linked))
        if not len(open_):
            continue
        rows = batch.take(pa.array(open_)).select([0, 1, 2, 3])
        if head is not None:
            rows = pa.concat_batches([head, rows])
        s, tie, pos = np.asarray(rows.column(0)), np.asarray(rows.column(2)), np.asarray(rows.column(3))
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        rank = pc.rank(rows.column(1), tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64)
        other = np.flatnonzero(~new & ((rank != rank[first]) | (tie != tie[first])))
        to = first[other]
        ids = rows.column(1)
        yield pa.record_batch(
            [ids.take(pa.array(other)), pa.array(tie[other]), pa.array(pos[other]), ids.take(pa.array(to)), pa.array(tie[to]), pa.array(pos[to])], _SEEDS[1:]
        )
        to = np.unique(to)
        yield pa.record_batch([ids.take(pa.array(to)), pa.array(tie[to]), pa.array(pos[to]), *_held(len(to), ids.type)], _SEEDS[1:])
        head = rows.slice(int(first[-1]), 1)


class Fenwick:
    """Greatest value and its owner among places before a bound."""

    def __init__(self, size: int):
        self.value = [float("-inf")] * (size + 1)
        self.owner = [-1] * (size + 1)

    def raise_to(self, place: int, value: float, owner: int) -> None:
        values, owners = self.value, self.owner
        place, size = place + 1, len(values)
        while place < size:
            if value > values[place]:
                values[place], owners[place] = value, owner
            place += place & -place

    def best_before(self, place: int) -> tuple[float, int]:
        values, best, where = self.value, float("-inf"), 0
        while place > 0:
            if values[place] > best:
                best, where = values[place], place
            place &= place - 1
        return best, self.owner[where]


def chain(x: list[int], y: list[int], k: int = K, gap_cost: float = GAP_COST) -> list[tuple[float, list[int]]]:
    """Chains of links (x, y), sorted by x and y, as (score, link numbers); a link is in one chain at most.

    A link is worth k words, or as many as it adds to the link before. Links of a chain rise in both
    coordinates. Every word between two links costs `gap_cost` on each side.
    """
    places = sorted(set(y))
    if len(places) == 1:  # no two links rise
        return [(float(k), [q]) for q in range(len(x))]
    tree = Fenwick(len(places))
    score, before, at = [0.0] * len(x), [-1] * len(x), []
    i = 0
    while i < len(x):
        j = i
        while j < len(x) and x[j] == x[i]:
            at.append(bisect_left(places, y[j]))
            best, owner = tree.best_before(at[j])
            here = best - gap_cost * (x[j] + y[j])
            worth = float(k)
            if owner >= 0:
                worth = float(min(k, x[j] - x[owner], y[j] - y[owner]))
            if owner >= 0 and here > 0:
                score[j], before[j] = here + worth, owner
            else:
                score[j] = float(k)
            j += 1
        for q in range(i, j):
            tree.raise_to(at[q], score[q] + gap_cost * (x[q] + y[q]), q)
        i = j
    used, found = [False] * len(x), []
    for end in sorted(range(len(x)), key=lambda q: (-score[q], q)):
        if used[end]:
            continue
        links, link = [], end
        while link >= 0 and not used[link]:
            used[link] = True
            links.append(link)
            link = before[link]
        found.append((score[end] - (score[link] if link >= 0 else 0.0), links[::-1]))
    return found


def _by_pair(groups, columns: tuple[int, ...] = (0, 1, 3, 4)):
    """Hands the links of whole pairs of texts, which come sorted, and their numbers to `groups`; or those of whole texts, by their columns."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            batch = batch if held is None else pa.concat_batches([held, batch])
            if not batch.num_rows:
                continue
            key = _group_numbers(batch, columns)
            cut = int(np.searchsorted(key, key[-1]))
            held = batch.slice(cut)  # the last text may go on; its links are no more than its words
            if cut:
                yield groups(batch.slice(0, cut), key[:cut])
        if held is not None:
            yield groups(held, np.zeros(held.num_rows, np.int64))

    return build


def _chains(least: int):
    """Groups of links, which come sorted, to a row per pair with all its chains that may reach over `least` words: their links in a row, and how many each has."""
    names = ["id", "tie", "sid", "stie", "xs", "ys", "sizes"]

    def groups(batch: pa.RecordBatch, key: np.ndarray) -> pa.RecordBatch:
        x, y = np.asarray(batch.column(2)), np.asarray(batch.column(5))
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        end = np.append(begin[1:], len(key))
        rows, xs, ys, sizes = [], [], [], []
        for a, b in zip(begin.tolist(), end.tolist()):
            px, py = x[a:b].tolist(), y[a:b].tolist()
            found = [links for _, links in chain(px, py) if min(px[links[-1]] - px[links[0]], py[links[-1]] - py[links[0]]) + K + 2 * MARGIN >= least]
            if found:
                rows.append(a)
                xs.append([px[q] for links in found for q in links])
                ys.append([py[q] for links in found for q in links])
                sizes.append([len(links) for links in found])
        take = pa.array(rows, pa.int64())
        lists = pa.list_(pa.int64())
        return pa.record_batch([*(batch.column(c).take(take) for c in (0, 1, 3, 4)), *(pa.array(v, lists) for v in (xs, ys, sizes))], names)

    return _by_pair(groups)


def _run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of `length` words that begin at each word; the last `length` - 1 mean nothing."""
    out, done, part, w = None, 0, h, 1
    while w <= length:
        if length & w:
            out = part if out is None else mix(out * U64(3) + np.roll(part, -done) * U64(5))
            done += w
        part, w = mix(part * U64(3) + np.roll(part, -w) * U64(5)), 2 * w
    return out


#: What is known of a text: a seed that others have, a passage found in it, words of one that are equal without a gap, words that a single link found equal.
HELD, FOUND, EXACT, ALIKE = 0, 1, 2, 3


def mark(kind: int, start, end):
    """A mark as one number."""
    return kind * 2**60 + start * 2**30 + end


def _stretches(length: int, k: int = K, window: int = WINDOW):
    """(id, tie, text, marks) to the runs of `length` words that other texts may have too, as rows for _link.

    In both texts of a common run, the windows within it have the same least shingles: all of them have to be held
    by others. `pos` is twice the first word, plus one where a passage of several links covers the run, which then
    only answers, unless a single link found it equal.
    """
    n = length - k - window + 2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(2))
            tie, lists = np.asarray(batch.column(1)), batch.column(3)
            marks, count = np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))
            of, kind = np.repeat(np.arange(len(count)), count), marks >> 60
            start, end = (marks >> 30) & (2**30 - 1), marks & (2**30 - 1)
            parts = []
            for a, b in chunks(off, 1 << 20):
                words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                size = len(words.hash)
                if size < max(k, length):
                    continue
                here = (of >= a) & (of < b)
                at = words.first[np.where(here, of - a, 0)] + start
                fits = np.arange(size) + length <= words.first[words.row + 1]
                if n > 0:
                    least, whole, _ = _least(words, k, window)
                    known = at[here & (kind == HELD)]
                    picked = np.unique(least[whole])
                    own = lambda w: mix(_seed_hashes(words, w, k) + words.row[w].astype(np.uint64) * U64(0x9E3779B97F4A7C15))
                    held = np.zeros(size, bool)
                    held[picked] = np.isin(own(picked), own(known))
                    good = np.concatenate([[0], np.cumsum(whole & held[least])])
                    asks = np.zeros(size, bool)
                    asks[: max(0, len(good) - n)] = good[n:] - good[:-n] == n
                    fits &= asks
                inside = {}
                for what in (FOUND, EXACT, ALIKE):
                    these = here & (kind == what) & (end - start >= length)
                    level = np.zeros(size + 1, np.int64)
                    np.add.at(level, at[these], 1)
                    np.add.at(level, at[these] + (end - start - length + 1)[these], -1)
                    inside[what] = np.cumsum(level)[:size] > 0
                p = np.flatnonzero(fits & ~inside[EXACT])
                parts.append((_run_hashes(words.hash, length)[p], words.row[p] + a, 2 * (p - words.first[words.row[p]]) + (inside[FOUND] & ~inside[ALIKE])[p]))
            if parts:
                yield from _tell(*(np.concatenate(x) for x in zip(*parts)), batch.column(0), tie)

    return build


def _join_exact(batch: pa.RecordBatch, text: np.ndarray) -> pa.RecordBatch:
    """Equal stretches (id, tie, start, sid, stie, source_start, n, old) of whole texts to passages.

    Those of a pair at the same distance that overlap or touch are one. A text that repeats itself, such as one word
    a hundred times, finds its runs at the same few places over and over: these are one, too, if no run is between
    them. One that lies in another of the text is left out, unless it is an old one: each of its runs is in the other.
    """
    x, y, n, old = (np.asarray(batch.column(c)) for c in (2, 5, 6, 7))
    pair = _group_numbers(batch)
    order = np.lexsort((x, x - y, pair))
    x, y, n, old, pair = x[order], y[order], n[order], old[order], pair[order]
    new = np.ones(len(x), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (np.diff(x - y) != 0)
    base = np.cumsum(new) << 31
    reach = np.maximum.accumulate(base + x + n)
    new[1:] |= base[1:] + x[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(x)) - 1
    start, other, end = x[begin], y[begin], (reach - base)[last]
    old = np.logical_or.reduceat(old > 0, begin)
    least = np.minimum.reduceat(n, begin)
    pair, of = pair[begin], order[begin]
    order = np.lexsort((end, start, pair))
    start, other, end, old, least, pair, of = (v[order] for v in (start, other, end, old, least, pair, of))
    until = other + end - start
    new = np.ones(len(start), bool)
    new[1:] = (pair[1:] != pair[:-1]) | old[1:] | old[:-1] | (start[1:] > end[:-1] - least[:-1] + 1) | (other[1:] >= until[:-1]) | (until[1:] <= other[:-1])
    begin = np.flatnonzero(new)
    start, end, old, of = start[begin], np.maximum.reduceat(end, begin), old[begin], of[begin]
    other, until = np.minimum.reduceat(other, begin), np.maximum.reduceat(until, begin)
    base = text[of] << 31
    widest = np.lexsort((of, -end, base + start))
    far = np.maximum.accumulate((base + end)[widest])
    alone = np.ones(len(begin), bool)
    alone[widest[1:]] = (base + end)[widest[1:]] > far[:-1]
    keep = np.flatnonzero(alone | old)
    take, numbers = pa.array(of[keep]), [pa.array(v[keep]) for v in (start, end, other, until, end - start)]
    return pa.record_batch([batch.column(0).take(take), batch.column(3).take(take), *numbers, pa.array(np.ones(len(keep)))], _FOUND)


_FOUND = ["id", "source_id", "start", "end", "source_start", "source_end", "n_words", "identity"]


def _group_numbers(batch: pa.RecordBatch, columns: tuple[int, ...] = (0, 1, 3, 4)) -> np.ndarray:
    """Numbers that rise wherever one of the columns, by default (id, tie, sid, stie), changes."""
    change = np.zeros(batch.num_rows, bool)
    for c in columns:
        rank = pc.rank(batch.column(c), tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64)
        change[1:] |= rank[1:] != rank[:-1]
    return np.cumsum(change)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short runs of words."""
    n = min(len(a), len(b))
    if not n:
        return 0
    head = int(np.append(a[:n] == b[:n], False).argmin())  # what both begin or end with is in one of the longest
    if head == n:
        return n
    n -= head
    a, b = a[head:], b[head:]
    tail = int(np.append(a[: -n - 1 : -1] == b[: -n - 1 : -1], False).argmin())
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    if len(a) == 1 or len(b) == 1:
        return head + tail + bool((a == b).any())
    row = np.zeros(len(b) + 1, np.int64)
    for word in a:
        hit = row[:-1] + (b == word)
        new = np.maximum(hit, row[1:])
        row[1:] = np.maximum.accumulate(new)
    return head + tail + int(row[-1])


def inner(a: np.ndarray, b: np.ndarray, xs: list[int], ys: list[int], k: int = K) -> int:
    """Equal words from the first to the last link of a chain: links are equal, gaps are aligned."""
    equal, px, py = 0, xs[0], ys[0]
    for x, y in zip(xs, ys):
        if x > px or y > py:
            equal += common(a[px:x], b[py:y])
        overlap = max(0, px - x, py - y)
        equal += k - overlap if px > x or py > y else k
        px, py = max(px, x + k), max(py, y + k)
    return equal


def align(a: np.ndarray, b: np.ndarray, xs: list[int], ys: list[int], k: int = K) -> tuple[int, int, int, int, int]:
    """(start, end, start, end, equal words) of the passage around a chain: the ends go on while words agree. What align_all does, for one."""
    px, py = xs[-1] + k, ys[-1] + k
    s, t, more = _extend(a[: xs[0]][::-1], b[: ys[0]][::-1])
    e, f, extra = _extend(a[px:], b[py:])
    return xs[0] - s, px + e, ys[0] - t, py + f, min(inner(a, b, xs, ys, k) + more + extra, px + e - xs[0] + s)


#: Words that are held for chains to be aligned at once, about; a chain counts as 200.
_TOGETHER = 2_000_000


def _is_passage(sides: np.ndarray, least_words: int, least_identity: float) -> np.ndarray:
    n, m = sides[1] - sides[0], sides[3] - sides[2]
    return (np.minimum(n, m) >= least_words) & (sides[4] >= least_identity * np.maximum(n, m))


def _judge(held: list[tuple], least_words: int, least_identity: float, whole: bool) -> list[tuple]:
    """Passages of chains, and a row per pair that marks what its single links found equal, and one with those whose alignment goes on unless the words are `whole`.

    A pair is held as (row, words, words of the source, first links, last links, equal words, links of each chain,
    where its pieces stand and begin and end).
    """
    if not held:
        return []
    size = np.array([[len(one[c]) for one in held] for c in (1, 2, 5)])
    of = np.repeat(np.arange(len(held)), size[2])
    base, from_ = (np.cumsum(size[c]) - size[c] for c in (0, 1))
    mine, theirs = (np.concatenate([one[c] for one in held]) for c in (1, 2))
    first, last = (np.concatenate([one[c] for one in held], axis=1) for c in (3, 4))
    equal, links, place, low, high = (np.concatenate([one[c] for one in held]) for c in (5, 6, 7, 8, 9))
    shift = np.array([base[of] + place, from_[of]])
    bounds = np.array([base[of] + low, base[of] + high, from_[of], (from_ + size[1])[of]])
    single = links == 1
    sides, more = align_all(mine, theirs, first + shift, last + shift, equal, bounds, whole)
    good = _is_passage(sides, least_words, least_identity)
    going = single & more & (not whole)
    if whole and not good.all():  # too many words differ further on
        near, _ = align_all(mine, theirs, (first + shift)[:, ~good], (last + shift)[:, ~good], equal[~good], bounds[:, ~good], False)
        sides[:, ~good] = near
        good = _is_passage(sides, least_words, least_identity)
    sides[:2] -= shift[0]
    sides[2:4] -= shift[1]
    alike = good & ~going & single & (sides[4] == np.maximum(sides[1] - sides[0], sides[3] - sides[2]))
    out = []
    for g in np.unique(of[alike]).tolist():  # the second round finds all that is equal word for word
        those = alike & (of == g)
        out.append((held[g][0], *[None] * 6, np.unique(mark(ALIKE, sides[0, those], sides[1, those])), True, None, None))
    for q in np.flatnonzero(good & ~going & ~alike).tolist():
        s, e, t, f, same = sides[:, q].tolist()
        longer, one, runs = max(e - s, f - t), held[of[q]], []
        if not single[q]:
            chain_ = q - int(np.searchsorted(of, of[q]))
            a, b = one[1][s + place[q] : e + place[q]], one[2][t:f]
            runs = [mark(FOUND, s, e), *(mark(EXACT, u, v) for u, v in _equal_runs(a, b, s, t, one[10][chain_], least_words))]
        out.append((one[0], s, e, t, f, e - s, same / longer, runs, bool(single[q]), None, None))
    for g in np.unique(of[going]).tolist():
        those = going & (of == g)
        out.append((held[g][0], *[None] * 7, True, *first[:, those]))
    return out


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """The words of the text of each row; a text that several rows in a row have is read once."""
    data, off = utf8(batch.column(column))
    raw, before, words = data.tobytes(), None, None
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        text = raw[a:b]
        if text != before:
            before, words = text, Words(data[a:b], np.array([0, b - a])).hash
        yield words


def _values(batch: pa.RecordBatch, column: int, row: int) -> np.ndarray:
    """The numbers of a list."""
    return batch.column(column)[row].values.to_numpy()


def _again(pair: tuple, xs: np.ndarray, before: tuple | None) -> bool:
    """Whether the same chains of a pair have just been seen."""
    return before is not None and pair == before[0] and np.array_equal(xs, before[1])


def _pieces(xs: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the words around the chains of a text of `n` words begin, and how many there are; what overlaps or touches is one."""
    last = np.cumsum(sizes) - 1
    low, high = np.maximum(xs[last - sizes + 1] - MARGIN, 0), np.minimum(xs[last] + K + MARGIN, n)
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.append(True, low[1:] > reach[:-1]))
    return low[new], reach[np.append(new[1:], len(low)) - 1] - low[new]


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How far two runs agree from their beginning: the ends of the best alignment from there, and its equal words.

    An equal word gains 1; one that is replaced, missing or put in costs DIFFERENT.
    """
    n = min(len(a), len(b))
    same = int(np.argmin(np.append(a[:n] == b[:n], False)))  # most go on without a difference, or not at all
    if same == n:
        return n, n, n
    a, b = a[same : same + MARGIN], b[same : same + MARGIN]
    slope = DIFFERENT * np.arange(len(b) + 1)
    row, best, e, f = -slope, 0.0, 0, 0
    for i, word in enumerate(a, 1):
        step = np.append(row[0] - DIFFERENT, np.maximum(row[1:] - DIFFERENT, row[:-1] + np.where(b == word, 1.0, -DIFFERENT)))
        row = np.maximum.accumulate(step + slope) - slope
        j = int(row.argmax())
        if row[j] > best:
            best, e, f = float(row[j]), i, j
        elif row[j] < best - 8 * DIFFERENT:
            break
    return same + e, same + f, same + common(a[:e], b[:f])


def _extend_all(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_extend for a run per row, of `la` and `lb` words; what stands behind them means nothing. And whether the alignment still held where the words that fit into a row ended."""
    n, width = a.shape
    at = np.arange(width)
    same = np.argmin(np.append((a == b) & (at < np.minimum(la, lb)[:, None]), np.zeros((n, 1), bool), axis=1), axis=1)
    ends = np.array([same, same, same])
    more = same == width
    rest = np.flatnonzero(same < np.minimum(la, lb))
    step_to = np.minimum(same[rest, None] + at, width - 1)
    a, b = np.take_along_axis(a[rest], step_to, 1), np.take_along_axis(b[rest], step_to, 1)
    full = (la == width) | (lb == width)
    la, lb = (la - same)[rest], (lb - same)[rest]
    slope = DIFFERENT * np.arange(width + 1)
    beyond = np.where(np.arange(width + 1) > lb[:, None], -np.inf, 0.0)
    ended = (lb < width).any()
    row, best, equal = np.tile(-slope, (len(rest), 1)), np.zeros(len(rest)), np.zeros((len(rest), width + 1), np.int16)
    shortest = la.min(initial=width)
    for i in range(1, width + 1):
        if i > shortest:
            on = i <= la
            if not on.all():
                more[rest[~on]] = full[rest[~on]]
                rest, a, b, la, beyond, row, best, equal = (v[on] for v in (rest, a, b, la, beyond, row, best, equal))
            shortest = la.min(initial=width)
        if not len(rest):
            break
        hit = b == a[:, i - 1, None]
        step = row - DIFFERENT
        np.maximum(step[:, 1:], row[:, :-1] + np.where(hit, 1.0, -DIFFERENT), out=step[:, 1:])
        step += slope
        row = np.maximum.accumulate(step, axis=1)
        row -= slope
        equal[:, 1:] = np.maximum.accumulate(np.maximum(equal[:, :-1] + hit, equal[:, 1:]), axis=1)
        j = (row + beyond if ended else row).argmax(axis=1)
        value = row[np.arange(len(j)), j]
        up = value > best
        if up.any():
            whom, to = rest[up], j[up]
            ends[0, whom], ends[1, whom], ends[2, whom] = same[whom] + i, same[whom] + to, same[whom] + equal[up, to]
            best = np.where(up, value, best)
        on = ~(value < best - 8 * DIFFERENT)
        if not on.all():
            rest, a, b, la, beyond, row, best, equal = (v[on] for v in (rest, a, b, la, beyond, row, best, equal))
    more[rest] = full[rest]
    return ends, more


def _extend_from(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, way: np.ndarray, on: bool) -> tuple[np.ndarray, np.ndarray]:
    """_extend for many places `x` of `a` and `y` of `b`, forwards or backwards (`way` 1 or -1) up to an end each: by MARGIN words, or from there `on`, as long as something is gained. And which may go on."""
    total, going, more = np.zeros((3, len(x)), np.int64), np.arange(len(x)), np.zeros(len(x), bool)
    while len(going):
        ahead, runs = way[going], []
        step = ahead[:, None] * np.arange(MARGIN) - (ahead < 0)[:, None]
        for words, at, end, gone in ((a, x, end_a, total[0]), (b, y, end_b, total[1])):
            place = at[going] + ahead * gone[going]
            runs += [words[np.clip(place[:, None] + step, 0, len(words) - 1)], np.clip(ahead * (end[going] - place), 0, MARGIN)]
        gained, more[going] = _extend_all(runs[0], runs[2], runs[1], runs[3])
        total[:, going] += gained
        going = going[more[going] & (gained[0] + gained[1] > 0)] if on else going[:0]
    return total, more


def align_all(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray, equal: np.ndarray, bounds: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """align for many chains, whose `first` and `last` links are words of `a` and of `b`, with the `equal` words from one to the other.

    `bounds` tell where their texts begin and end in `a` and in `b`. By MARGIN words each way, or where `on` as far as they agree; and whether there is more to look at behind.
    """
    n = len(equal)
    both, more = _extend_from(a, b, *np.append(last + K, first, axis=1), *np.append(bounds[[1, 3]], bounds[[0, 2]], axis=1), np.repeat([1, -1], n), on)
    ends, begins = both[:, :n], both[:, n:]
    sides = np.array([first[0] - begins[0], last[0] + K + ends[0], first[1] - begins[1], last[1] + K + ends[1]])
    return np.array([*sides, np.minimum(equal + ends[2] + begins[2], sides[1] - sides[0])]), more[:n] | more[n:]


def _equal_runs(a: np.ndarray, b: np.ndarray, s: int, t: int, shifts: set[int], least: int) -> list[tuple[int, int]]:
    """Where `a`, which begins at s, has `least` or more words in a row that `b`, which begins at t, has at one of the shifts too."""
    found = []
    for shift in shifts:
        low, high = max(s, t + shift), min(s + len(a), t + len(b) + shift)
        if high - low >= least:
            same = np.concatenate([[False], a[low - s : high - s] == b[low - shift - t : high - shift - t], [False]])
            edge = np.flatnonzero(same[1:] != same[:-1])
            found += [(low + int(u), low + int(v)) for u, v in zip(edge[::2], edge[1::2]) if v - u >= least]
    return found


def repeated_passages(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 40, least_identity: float = 0.7
) -> DataFrame:
    """(id, source_id, start, end, source_start, source_end, n_words, identity): passages of a text that an earlier text has too, if fuzzily.

    Positions are words `[^\\x20\\x09-\\x0D]+`, A-Z lowered; `identity` is the share of equal words in the
    alignment. A passage is linked to the text of smallest id that has its seeds, in the task or in all, and
    not to every text that has it. One seed is enough, and its passage goes on as far as the words agree, wherever else in the text or its source they are found too. Every run of `least_words` words that an earlier text has too, word for word,
    lies in a passage; the one that the seeds lead to, or else the first text that has the run. Of a stretch that
    repeats itself, the source may be shorter: each run of the stretch is somewhere in it. Null and empty texts, and those of fewer than K words, have no passages. A
    null id comes before all others. Rows that repeat an id and its text count as one; other texts of that id
    are other texts. Other columns are not looked at.
    """
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    found = texts.mapInArrow(_find_seeds, f"seed long, id {kind}, tie long, pos long, sid {kind}, stie long, spos long")

    def linked(rows: DataFrame) -> DataFrame:
        return rows.repartition("seed").sortWithinPartitions("seed", "id", "tie", "pos").mapInArrow(
            _link, f"id {kind}, tie long, pos long, sid {kind}, stie long, spos long"
        )

    def by_pair(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions("id", "tie", "sid", "stie", "pos", "spos")

    links = settle(linked(found), "links")
    pair = f"id {kind}, tie long, sid {kind}, stie long, xs array<long>, ys array<long>, sizes array<long>"
    chained = by_pair(links.where("spos >= 0"), "id", "tie", "sid", "stie").mapInArrow(_chains(least_words), pair)

    def cut(whole: bool):
        """The words of a text around the chains of each pair, or all of them, as pieces that begin at some words of it.

        Where rows repeat an id and its text, a pair comes once for each of them, one after the other; it goes on once.
        """

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = None
            for batch in batches:
                pairs, out = list(zip(*(c.to_pylist() for c in batch.columns[:4]))), []
                for x, words in enumerate(_texts(batch, 7)):
                    if not _again(pairs[x], _values(batch, 4, x), before):
                        before = pairs[x], _values(batch, 4, x)
                        begins, size = (np.zeros(1, np.int64), np.array([len(words)])) if whole else _pieces(_values(batch, 4, x), _values(batch, 6, x), len(words))
                        out.append((x, begins, size, np.concatenate([words[a : a + n] for a, n in zip(begins.tolist(), size.tolist())]).tobytes()))
                take = pa.array([o[0] for o in out], pa.int64())
                lists = (pa.array([o[c] for o in out], pa.list_(pa.int64())) for c in (1, 2))
                yield pa.record_batch([*(c.take(take) for c in batch.columns[:7]), *lists, pa.array([o[3] for o in out], pa.binary())], _CUT)

        return build

    def judge(whole: bool):
        """Passages around the chains of each pair. Single links whose alignment goes on behind MARGIN words come back as they are, unless the words are whole."""

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = None
            for batch in batches:
                pairs, out, held, size_held = list(zip(*(c.to_pylist() for c in batch.columns[:4]))), [], [], 0
                for x, words in enumerate(_texts(batch, 10)):
                    xs, ys, sizes, begins, size = (_values(batch, c, x) for c in range(4, 9))
                    if _again(pairs[x], xs, before):
                        continue
                    before = pairs[x], xs
                    mine = np.frombuffer(batch.column(9)[x].as_buffer(), np.uint64)
                    place = np.cumsum(size) - size - begins  # from a word of the text to its place in the pieces
                    last = np.cumsum(sizes)
                    first = last - sizes
                    piece = np.searchsorted(begins, xs[first], "right") - 1
                    equal, shifts, place = np.full(len(sizes), K), {}, place[piece]
                    for c in np.flatnonzero(sizes > 1).tolist():
                        at = slice(first[c], last[c])
                        equal[c] = inner(mine, words, (xs[at] + place[c]).tolist(), ys[at].tolist())
                        shifts[c] = set((xs[at] - ys[at]).tolist())
                    low = begins[piece] + place
                    ends = [np.array([xs[at], ys[at]]) for at in (first, last - 1)]
                    for c in range(0, len(sizes), _TOGETHER // 200):
                        some = slice(c, c + _TOGETHER // 200)
                        held.append((x, mine, words, *(v[:, some] for v in ends), equal[some], sizes[some], place[some], low[some], (low + size[piece])[some], {q - c: v for q, v in shifts.items()}))
                        size_held += 200 * len(sizes[some]) + len(mine) + len(words)
                        if size_held >= _TOGETHER:
                            out += _judge(held, least_words, least_identity, whole)
                            held, size_held = [], 0
                out += _judge(held, least_words, least_identity, whole)
                take = pa.array([r[0] for r in out], pa.int64())
                kinds = [pa.int64()] * 5 + [pa.float64(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                numbers = [pa.array([r[c] for r in out], t) for c, t in enumerate(kinds, 1)]
                yield pa.record_batch([*(batch.column(c).take(take) for c in (0, 2, 1, 3)), *numbers], [*_FOUND[:2], "tie", "stie", *_FOUND[2:], "runs", "single", "xs", "ys"])

        return build

    numbers = "start long, end long, source_start long, source_end long, n_words long, identity double"
    schema = f"id {kind}, source_id {kind}, {numbers}"

    def judged_of(pairs: DataFrame, whole: bool) -> DataFrame:
        mine = pairs.alias("c").join(texts.alias("t"), F.col("c.id").eqNullSafe(F.col("t.id")) & (F.col("c.tie") == F.col("t.tie")))
        parts = mine.select("c.*", "t.text").mapInArrow(cut(whole), f"{pair}, begins array<long>, size array<long>, words binary")
        theirs = parts.alias("c").join(texts.alias("t"), F.col("c.sid").eqNullSafe(F.col("t.id")) & (F.col("c.stie") == F.col("t.tie")))
        out = f"id {kind}, source_id {kind}, tie long, stie long, {numbers}, runs array<long>, single boolean, xs array<long>, ys array<long>"
        return settle(theirs.select("c.*", "t.text").mapInArrow(judge(whole), out), "passages")

    near = judged_of(chained, False)
    judged = near.where("xs is null").drop("xs", "ys")
    going_on = near.where("xs is not null").select("id", "tie", F.col("source_id").alias("sid"), "stie", "xs", "ys", F.transform("xs", lambda _: F.lit(1).cast("long")).alias("sizes"))
    if not going_on.isEmpty():
        release(df.sparkSession)
        judged = judged.unionByName(judged_of(going_on, True).drop("xs", "ys"))

    known = links.select("id", "tie", mark(F.lit(HELD), F.col("pos"), F.lit(0)).alias("mark"))
    marks = known.union(judged.select("id", "tie", F.explode("runs"))).groupBy("id", "tie").agg(F.collect_set("mark").alias("marks"))
    asked = texts.alias("t").join(marks.alias("m"), F.col("t.id").eqNullSafe(F.col("m.id")) & (F.col("t.tie") == F.col("m.tie")))
    runs = asked.select("t.id", "t.tie", "t.text", "m.marks").mapInArrow(_stretches(least_words), found.schema.simpleString()[7:-1].replace(":", " "))
    half = lambda c: F.shiftright(c, 1).alias(c)
    same = linked(runs).where("spos >= 0 and pos % 2 = 0").select("id", "tie", half("pos"), "sid", "stie", half("spos"), F.lit(least_words).cast("long").alias("n"), F.lit(0).alias("old"))
    whole = judged.where("identity = 1 and not single").select("id", "tie", F.col("start").alias("pos"), F.col("source_id").alias("sid"), "stie", F.col("source_start").alias("spos"), F.col("n_words").alias("n"), F.lit(1).alias("old"))
    exact = by_pair(same.union(whole), "id", "tie").mapInArrow(_by_pair(_join_exact, (0, 1)), schema)
    return judged.where("identity < 1").select(_FOUND).union(exact).distinct().withColumnRenamed("id", id_col)


_CUT = ["id", "tie", "sid", "stie", "xs", "ys", "sizes", "begins", "size", "words"]
