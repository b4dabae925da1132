"""Jaccard join of word shingles with a count-vector R-tree.

The shingles of a text are hashed into groups; the numbers per group are a point. The overlap of two texts
is at most the sum of the lesser coordinates of their points, and that of two boxes of points at most the
same sum over the boxes' upper corners. Pairs that survive these bounds are verified on the shingles.

Near copies are the only points that are close in many dimensions, so one tree over all points would have
to open every page. The texts are therefore dealt to trees by the shingles of their prefix: texts that
reach the threshold share shingles among the first few of either, in any fixed order of all shingles. In
that order, shingles that several texts of a sample have come last, which changes cost and no result.

Links are needed for classes, not one by one. A first round tries each text with the most connected texts of its
trees, and what links makes classes. Then a tree whose members are all of one class is done. In the others a class is
one box, whatever its size: boxes of a tree are held against each other, a pair of classes is kept once, however many
trees tell it, and is opened page by page and point by point. Of the pairs of texts that are left, a few per pair
of classes are verified at a time, until one links or none is left. So a large group of near copies costs rows in
proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from epochline.llm.arrow_text import U64, Words, chunks, mix, shingles, signed, small_batches, utf8
from epochline.llm.components import connected_components
from epochline.session import settle

#: One in SAMPLE distinct texts is looked at for shingles that COMMON of them have; these are marked among BITS bits, of as many as there
#: are up to BITS / 16, beyond which marks coincide and the order gets worse, but no result.
SAMPLE, COMMON, BITS = 16, 3, 1 << 27
#: First members of trees that a set is tried with in the first round: those that it shares most keys with.
TRIED = 3
#: Entries in a page, coordinates of its box, and nodes of a class above which its pages are dealt out.
PAGE, BOX, DEALT = 128, 64, 8192
#: Pairs of texts that are verified for a pair of classes, round by round; the last round takes the rest.
ROUNDS = (2, 20)
#: Shingles that texts have to share in their prefixes, which are longer by one less.
SHARED = 2
_FP = U64(0x9FB21C651E98DF25)


def text_sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, sorted distinct shingle hashes) of each text."""
    for a, b in chunks(off, 1 << 20):
        words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a])
        found, row = shingles(words, k)
        order = np.lexsort((found, row))
        found, row = found[order], row[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
        found, row = found[new], row[new]
        first = np.searchsorted(row, np.arange(b - a + 1))
        for x in range(b - a):
            yield a + x, found[first[x] : first[x + 1]]


def fingerprint(shingle_set: np.ndarray) -> int:
    return int((mix(shingle_set * _FP).sum(dtype=np.uint64) + U64(len(shingle_set))).view(np.int64)) if len(shingle_set) else 0


def groups(n: int) -> int:
    """Number of groups for a set of n shingles: about one to a group, so that only sets that share most of them seem to."""
    return 1 << min(16, max(3, max(n - 1, 1).bit_length()))


def point(shingle_set: np.ndarray) -> bytes:
    """Group counts, a byte each; four bytes each if one is over 255."""
    g = groups(len(shingle_set))
    counts = np.bincount((mix(shingle_set) & U64(g - 1)).astype(np.int64), minlength=g)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def coordinates(stored: bytes, n: int) -> np.ndarray:
    return np.frombuffer(stored, np.uint8 if len(stored) == groups(n) else np.uint32).astype(np.uint32)


def coarse_point(shingle_set: np.ndarray) -> bytes:
    """Counts of BOX groups, a byte each. A set too large for a byte gets the greatest value everywhere, which bounds nothing."""
    counts = np.bincount((mix(shingle_set) & U64(BOX - 1)).astype(np.int64), minlength=BOX)
    return (counts if counts.max() < 255 else np.full(BOX, 255)).astype(np.uint8).tobytes()


def fold(p: np.ndarray, g: int) -> np.ndarray:
    return p.reshape(-1, g).sum(axis=0)


def overlap_bound(p: np.ndarray, q: np.ndarray) -> int:
    g = min(len(p), len(q))
    return int(np.minimum(fold(p, g), fold(q, g)).sum())


def enough(overlap, n, m, num: int, den: int):
    """Whether an overlap of sets of n and m makes num / den of their union."""
    return den * overlap >= num * (n + m - overlap)


def _profile(k: int, num: int, den: int, common: np.ndarray):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            n, fp, points, coarse, keys, seen = [], [], [], [], [], set()
            for _, s in text_sets(data, off, k):
                node = (len(s), fingerprint(s))
                n.append(node[0])
                fp.append(node[1])
                if node in seen or not len(s):  # one of equal sets in a batch is enough
                    points.append(None)
                    coarse.append(None)
                    keys.append(None)
                    continue
                seen.add(node)
                points.append(point(s))
                coarse.append(coarse_point(s))
                ordered = mix(s)
                if len(common):
                    at = _place(s, len(common) * 8)
                    hot = common[at >> 3] >> (at & 7).astype(np.uint8) & 1
                    ordered = ordered >> U64(1) | (hot.astype(np.uint64) << U64(63))
                keys.append(s[np.argsort(ordered)[: len(s) - -(-num * len(s) // den) + SHARED]].view(np.int64))
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(points, pa.binary()), pa.array(coarse, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "tie", "n", "fp", "point", "coarse", "keys"],
            )

    return build


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, n, fp): the members of keys that several sets have."""
    last, pending = None, None  # last: key, member and number of members of the open key
    for batch in batches:
        key, n, fp = (np.asarray(batch.column(x)) for x in range(3))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (n[1:] != n[:-1]) | (fp[1:] != fp[:-1])
        if last and len(key) and (key[0], n[0], fp[0]) == last[:3]:
            fresh[0] = False
        key, n, fp = key[fresh], n[fresh], fp[fresh]
        if not len(key):
            continue
        begins = np.ones(len(key), bool)
        begins[1:] = key[1:] != key[:-1]
        goes_on = last is not None and last[0] == key[0]
        begins[0] = not goes_on
        group = np.cumsum(begins)
        count = np.bincount(group)
        if goes_on:
            count[0] += last[3]
            if pending is not None:
                yield pending
        pending = None
        keep = count[group] > 1
        if keep.any():
            yield pa.record_batch([pa.array(x[keep]) for x in (key, n, fp)], ["key", "n", "fp"])
        if not keep[-1]:
            pending = pa.record_batch([pa.array(x[-1:]) for x in (key, n, fp)], ["key", "n", "fp"])
        last = (key[-1], n[-1], fp[-1], int(count[group[-1]]))


def _node(n: str, fp: str) -> Column:
    return F.struct(F.col(n).alias("n"), F.col(fp).alias("fp"))


def _sizes_fit(a: str, b: str, num: int, den: int) -> Column:
    n, m = F.col(a), F.col(b)
    return den * F.least(n, m) >= num * F.greatest(n, m)


def _bounded(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose points allow the overlap."""
    a = points.select(F.col("node").alias("a"), F.col("point").alias("p"))
    b = points.select(F.col("node").alias("b"), F.col("point").alias("q"))
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", "p", "q")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (np.asarray(batch.column(x).field("n")) for x in (0, 1))
            p, q = (batch.column(x).to_pylist() for x in (2, 3))
            ok = [
                enough(min(overlap_bound(coordinates(x, int(i)), coordinates(y, int(j))), int(i), int(j)), int(i), int(j), num, den)
                for x, y, i, j in zip(p, q, n, m)
            ]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(keep, pairs.select("a", "b").schema)


def _verified(pairs: DataFrame, docs: DataFrame, profile: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that reach the threshold, from the shingles themselves. One text stands for all with the same set."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    chosen = settle(
        profile.select("id", _node("n", "fp").alias("node")).join(nodes, "node").groupBy("node").agg(F.min("id").alias("want")), "chosen"
    )
    texts = docs.join(chosen, F.col("id").eqNullSafe(F.col("want"))).select("node", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            sets = [s for _, s in text_sets(data, off, k)]
            mine = [(len(s), fingerprint(s)) == (x["n"], x["fp"]) for s, x in zip(sets, batch.column(0).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"]).filter(pa.array(mine, pa.bool_()))

    sets = texts.mapInArrow(build, "node struct<n:int,fp:long>, shingles binary").dropDuplicates(["node"])
    sets = settle(sets, "sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([s, t]), kind="stable")
                ok.append(enough(int((both[1:] == both[:-1]).sum()), len(s), len(t), num, den))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(judge, pairs.select("a", "b").schema)


NODE = pa.struct([("n", pa.int32()), ("fp", pa.int64())])
_PAIR = "a struct<n:int,fp:long>, b struct<n:int,fp:long>"
_FOUND = f"{_PAIR}, need int, key long, page int, low int, high int, corner binary, entries array<struct<class:struct<n:int,fp:long>,low:int,high:int,corner:binary>>"
#: A coordinate that stands for any number, in the corner of a set too large for a byte.
FULL = 255


def _nodes(n: np.ndarray, fp: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), pa.array(fp)], ["n", "fp"])


@dataclass
class Entries:
    """Boxes of classes within trees: key, class (n, fp), least and greatest size, upper corner."""

    key: np.ndarray
    n: np.ndarray
    fp: np.ndarray
    low: np.ndarray
    high: np.ndarray
    corner: np.ndarray

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.key, self.n, self.fp, self.low, self.high, self.corner

    def of(self, rows) -> Entries:
        return Entries(*(x[rows] for x in self.parts()))

    def __add__(self, other: Entries) -> Entries:
        return Entries(*(np.concatenate([x, y]) for x, y in zip(self.parts(), other.parts())))

    def __len__(self) -> int:
        return len(self.key)

    def boxes(self) -> Entries:
        """One entry per key and class; the rows are sorted by them."""
        if not len(self):
            return self
        new = np.ones(len(self), bool)
        new[1:] = (self.key[1:] != self.key[:-1]) | (self.n[1:] != self.n[:-1]) | (self.fp[1:] != self.fp[:-1])
        at = np.flatnonzero(new)
        corner = np.maximum.reduceat(self.corner, at, axis=0)
        return Entries(self.key[at], self.n[at], self.fp[at], np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), corner)


def _close(x: Entries, i: np.ndarray, y: Entries, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether boxes i of x and j of y, of different classes, may hold points of sets that reach the threshold."""
    ok = (x.n[i] != y.n[j]) | (x.fp[i] != y.fp[j])
    ok &= (den * x.high[i] >= num * y.low[j]) & (den * y.high[j] >= num * x.low[i])
    out = np.flatnonzero(ok)
    p, q = x.corner[i[out]], y.corner[j[out]]
    least = np.minimum(p, q).sum(axis=1, dtype=np.int64)
    least[(p[:, 0] == FULL) & (q[:, 0] == FULL)] = np.iinfo(np.int32).max
    ok[out] = (num + den) * least >= num * (x.low[i[out]] + y.low[j[out]])
    return ok


def _found(x: Entries, i: np.ndarray, y: Entries, j: np.ndarray, num: int, den: int) -> pa.RecordBatch:
    """Pairs of classes, the lesser first, and how many keys texts of theirs have to share."""
    swap = (x.n[i] > y.n[j]) | ((x.n[i] == y.n[j]) & (x.fp[i] > y.fp[j]))
    n, m, f, g = x.n[i], y.n[j], x.fp[i], y.fp[j]
    a, b = _nodes(np.where(swap, m, n), np.where(swap, g, f)), _nodes(np.where(swap, n, m), np.where(swap, f, g))
    need = np.minimum(SHARED, -(-num * (x.low[i] + y.low[j]) // (num + den)))
    return pa.record_batch([a, b, pa.array(need, pa.int32())], ["a", "b", "need"])


def _wide(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with nulls for the columns that it lacks."""
    have = {c: batch.column(c) for c in batch.schema.names}
    return pa.record_batch([have.get(f.name, pa.nulls(batch.num_rows, f.type)) if f.name not in have else have[f.name].cast(f.type) for f in schema], schema=schema)


_ENTRY = pa.struct([("class", NODE), ("low", pa.int32()), ("high", pa.int32()), ("corner", pa.binary())])
_FOUND_SCHEMA = pa.schema(
    [("a", NODE), ("b", NODE), ("need", pa.int32()), ("key", pa.int64()), ("page", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("corner", pa.binary()), ("entries", pa.list_(_ENTRY))]
)


def _rows(corner: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in corner], pa.binary())


def _corners(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BOX)


def _page(e: Entries, number: int) -> pa.RecordBatch:
    members = pa.StructArray.from_arrays([_nodes(e.n, e.fp), pa.array(e.low, pa.int32()), pa.array(e.high, pa.int32()), _rows(e.corner)], ["class", "low", "high", "corner"])
    columns = [
        pa.array([int(e.key[0])], pa.int64()),
        pa.array([number], pa.int32()),
        pa.array([int(e.low.min())], pa.int32()),
        pa.array([int(e.high.max())], pa.int32()),
        _rows(e.corner.max(axis=0)[None]),
        pa.ListArray.from_arrays(pa.array([0, len(e)], pa.int32()), members),
    ]
    return pa.record_batch(columns, ["key", "page", "low", "high", "corner", "entries"])


def _trees(num: int, den: int):
    """Members sorted by (key, class): pairs of classes of trees of one page; pages of larger ones."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, pages = None, 0  # entries of the open key, and pages of it that have been told
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, n = batch.column("class"), np.asarray(batch.column("n"), np.int64)
            here = Entries(np.asarray(batch.column("key")), np.asarray(kind.field("n"), np.int64), np.asarray(kind.field("fp")), n, n, _corners(batch.column("coarse")))
            entries = (here if rest is None else rest + here).boxes()
            cut = int(np.searchsorted(entries.key, entries.key[-1]))  # the last key may go on
            done, rest = entries.of(slice(0, cut)), entries.of(slice(cut, None))
            if len(done) and pages:
                first = int(np.searchsorted(done.key, done.key[0], "right"))
                yield from large(done.of(slice(0, first)), pages)
                done, pages = done.of(slice(first, None)), 0
            yield from small(done)
            while len(rest) > PAGE:  # the last entry may go on
                yield _wide(_page(rest.of(slice(0, PAGE)), pages), _FOUND_SCHEMA)
                rest, pages = rest.of(slice(PAGE, None)), pages + 1
        if rest is not None:
            yield from large(rest, pages) if pages else small(rest)

    def large(e: Entries, pages: int) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(e), PAGE):
            yield _wide(_page(e.of(slice(k, k + PAGE)), pages + k // PAGE), _FOUND_SCHEMA)

    def small(e: Entries) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.flatnonzero(np.concatenate([[True], e.key[1:] != e.key[:-1], [True]]))) if len(e) else np.zeros(0, int)
        over = np.repeat(sizes > PAGE, sizes)
        if over.any():  # a whole key of several pages within a batch
            for key in np.unique(e.key[over]):
                yield from large(e.of(e.key == key), 0)
            e = e.of(~over)
        for d in range(1, len(e)):
            i = np.flatnonzero(e.key[d:] == e.key[:-d])
            if not len(i):
                return
            for k in range(0, len(i), 1 << 16):
                part = i[k : k + (1 << 16)]
                ok = _close(e, part, e, part + d, num, den)
                if ok.any():
                    yield _wide(_found(e, part[ok], e, part[ok] + d, num, den), _FOUND_SCHEMA)

    return search


def _page_entries(rows: pa.ListScalar) -> Entries:
    v = rows.values
    n = np.asarray(v.field("class").field("n"), np.int64)
    return Entries(np.zeros(len(n), np.int64), n, np.asarray(v.field("class").field("fp")), np.asarray(v.field("low"), np.int64), np.asarray(v.field("high"), np.int64), _corners(v.field("corner")))


def _boxes_close(x: str, y: str, num: int, den: int) -> Column:
    """Whether two boxes, columns `low`, `high` and `corner` of each, may hold points that reach the threshold."""
    fits = (den * F.col(f"{x}.high") >= num * F.col(f"{y}.low")) & (den * F.col(f"{y}.high") >= num * F.col(f"{x}.low"))
    return fits & _corners_meet(F.col(f"{x}.corner"), F.col(f"{y}.corner"), F.col(f"{x}.low"), F.col(f"{y}.low"), F.lit(num), F.lit(den))


@F.pandas_udf(BooleanType())
def _corners_meet(p: pd.Series, q: pd.Series, n: pd.Series, m: pd.Series, num: pd.Series, den: pd.Series) -> pd.Series:
    if not len(p):
        return pd.Series([], dtype=bool)
    a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, BOX) for x in (p, q))
    least = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    least[(a[:, 0] == FULL) & (b[:, 0] == FULL)] = np.iinfo(np.int32).max
    return pd.Series((num + den) * least >= num * (n + m))


def _class_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes that share enough keys and whose boxes in a tree are close, each once.

    `members` has key, n, class and coarse. The boxes of a tree of one page are held against each other at once; of a larger
    one, first pages are held against pages.
    """
    rows = members.select("key", "n", "class", "coarse").repartition("key").sortWithinPartitions("key", "class")
    found = settle(rows.mapInArrow(_trees(num, den), _FOUND), "trees")
    pages = found.where(F.col("page").isNotNull()).select("key", "page", "low", "high", "corner", "entries")
    x, y = pages.alias("x"), pages.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.page") <= F.col("y.page"))).where(_boxes_close("x", "y", num, den))
    met = met.select((F.col("x.page") == F.col("y.page")).alias("own"), F.col("x.entries").alias("xs"), F.col("y.entries").alias("ys"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, xs, ys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                one, two = _page_entries(xs), _page_entries(ys)
                i, j = np.nonzero(np.triu(np.ones((len(one), len(two)), bool), 1 if own else -len(two)))
                ok = _close(one, i, two, j, num, den)
                if ok.any():
                    yield _found(one, i[ok], two, j[ok], num, den)

    pairs = found.where(F.col("page").isNull()).select("a", "b", "need").unionByName(met.mapInArrow(search, f"{_PAIR}, need int"))
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys"), F.min("need").alias("need"))
    return counted.where("keys >= need").select("a", "b")


_CLASS_PAGE = "class struct<n:int,fp:long>, deal int, page int, low int, high int, corner binary, nodes array<struct<n:int,fp:long>>, points array<binary>"


def _class_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points sorted by (class, deal, n, fp): pages of them with their boxes."""
    at, number, held = None, 0, None

    def page(rows: pa.RecordBatch) -> pa.RecordBatch:
        n = np.asarray(rows.column("n"))
        ends = pa.array([0, rows.num_rows], pa.int32())
        nodes = pa.StructArray.from_arrays([rows.column("n"), rows.column("fp")], ["n", "fp"])
        columns = [
            rows.column("class").slice(0, 1),
            rows.column("deal").slice(0, 1),
            pa.array([number], pa.int32()),
            pa.array([int(n.min())], pa.int32()),
            pa.array([int(n.max())], pa.int32()),
            _rows(_corners(rows.column("coarse")).max(axis=0)[None]),
            pa.ListArray.from_arrays(ends, nodes),
            pa.ListArray.from_arrays(ends, rows.column("point")),
        ]
        return pa.record_batch(columns, ["class", "deal", "page", "low", "high", "corner", "nodes", "points"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kind, deal = batch.column("class"), np.asarray(batch.column("deal"))
        n, fp = np.asarray(kind.field("n")), np.asarray(kind.field("fp"))
        cuts = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (fp[1:] != fp[:-1]) | (deal[1:] != deal[:-1])]))
        told = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
            here = (n[a], fp[a], deal[a])
            if here != at:
                if held is not None and held.num_rows:
                    told.append(page(held))
                at, number, held = here, 0, None
            part = batch.slice(a, b - a)
            held = part if held is None else pa.concat_batches([held, part])
            while held.num_rows > PAGE:
                told.append(page(held.slice(0, PAGE)))
                number, held = number + 1, held.slice(PAGE)
        if told:
            yield pa.concat_batches(told)
    if held is not None and held.num_rows:
        yield page(held)


def _text_pairs(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, x, y, spare): pairs of sets x, y of the classes a, b whose points allow the overlap, and by how much.

    `points` has node, class, point and coarse. The pages of two classes meet by their boxes first; only those that are close are
    opened.
    """
    open_ = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    rows = points.join(open_, "class")
    sizes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    deal = F.when(F.col("size") > DEALT, F.pmod(F.col("node.fp"), F.ceil(F.col("size") / DEALT) * 2)).otherwise(0).cast("int")
    rows = rows.join(sizes, "class").withColumn("deal", deal).select("class", "deal", "node.n", "node.fp", "point", "coarse")
    pages = settle(rows.repartition("class", "deal").sortWithinPartitions("class", "deal", "n", "fp").mapInArrow(_class_pages, _CLASS_PAGE), "pages")
    box = [F.col(c) for c in ("deal", "page", "low", "high", "corner")]
    left = pages.select(F.col("class").alias("a"), F.struct(*box).alias("x"))
    right = pages.select(F.col("class").alias("b"), F.struct(*box).alias("y"))
    met = pairs.join(left, "a").join(right, "b").where(_boxes_close("x", "y", num, den))
    met = met.select("a", "b", F.col("x.deal").alias("xd"), F.col("x.page").alias("xp"), F.col("y.deal").alias("yd"), F.col("y.page").alias("yp"))
    one = pages.select(F.col("class").alias("a"), F.col("deal").alias("xd"), F.col("page").alias("xp"), F.col("nodes").alias("xs"), F.col("points").alias("ps"))
    two = pages.select(F.col("class").alias("b"), F.col("deal").alias("yd"), F.col("page").alias("yp"), F.col("nodes").alias("ys"), F.col("points").alias("qs"))
    opened = met.join(one, ["a", "xd", "xp"]).join(two, ["b", "yd", "yp"]).select("a", "b", "xs", "ps", "ys", "qs")

    def open_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for r in range(batch.num_rows):
                xs, ps, ys, qs = (batch.column(c)[r].values for c in ("xs", "ps", "ys", "qs"))
                n, m = np.asarray(xs.field("n"), np.int64), np.asarray(ys.field("n"), np.int64)
                i, j, spare = _near_points(n, ps.to_pylist(), m, qs.to_pylist(), num, den)
                if len(i):
                    own = [batch.column(c).take(pa.array(np.full(len(i), r))) for c in ("a", "b")]
                    told.append(pa.record_batch([*own, xs.take(pa.array(i)), ys.take(pa.array(j)), pa.array(spare, pa.int64())], ["a", "b", "x", "y", "spare"]))
            if told:
                yield pa.concat_batches(told)

    return opened.mapInArrow(open_pages, f"{_PAIR}, x struct<n:int,fp:long>, y struct<n:int,fp:long>, spare long")


def _near_points(n: np.ndarray, ps: list[bytes], m: np.ndarray, qs: list[bytes], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of points whose sum of lesser coordinates allows the threshold, and by how much it does."""
    one = [coordinates(p, int(k)) for p, k in zip(ps, n)]
    stored: dict[tuple[int, bool], list[int]] = {}
    for j, q in enumerate(qs):
        stored.setdefault((groups(int(m[j])), len(q) == groups(int(m[j]))), []).append(j)
    out_i, out_j, out = [], [], []
    for (size, plain), js in stored.items():
        whole = np.frombuffer(b"".join([qs[j] for j in js]), np.uint8 if plain else np.uint32).reshape(len(js), size)
        at, folded = np.array(js), {size: whole}
        for i, p in enumerate(one):
            g = min(len(p), size)
            if g not in folded:
                folded[g] = whole.astype(np.uint32).reshape(len(js), -1, g).sum(axis=1)
            p = fold(p, g)
            p = p.astype(np.uint8) if folded[g].dtype == np.uint8 and p.max() < 256 else p
            bound = np.minimum(np.minimum(folded[g], p).sum(axis=1, dtype=np.int64), np.minimum(n[i], m[at]))
            spare = den * bound - num * (n[i] + m[at] - bound)
            ok = spare >= 0
            if ok.any():
                out_i += [i] * int(ok.sum())
                out_j += at[ok].tolist()
                out += spare[ok].tolist()
    return np.array(out_i, np.int64), np.array(out_j, np.int64), np.array(out, np.int64)


def _place(shingle_set: np.ndarray, bits: int) -> np.ndarray:
    return (mix(shingle_set * U64(0xD6E8FEB86659FD93)) & U64(bits - 1)).astype(np.int64)


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Bits that mark shingles which several distinct texts of a sample have. They only decide an order."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(0))
            sets = [s for _, s in text_sets(data, off, k)]
            found, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.record_batch([signed(found), pa.array(count)], ["shingle", "n"])

    some = docs.where(F.pmod("tie", F.lit(SAMPLE)) == 0).dropDuplicates(["tie"]).select("text")
    counts = some.mapInArrow(build, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    counts = settle(counts.select("shingle"), "common")
    bits = min(BITS, 1 << max(10, (16 * counts.count()).bit_length()))
    part = max(8, bits // 64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, None
        for batch in batches:
            at = _place(np.asarray(batch.column(0)).view(np.uint64), bits)
            for own in np.unique(at // part).tolist():
                if own != number:
                    if number is not None:
                        yield pa.record_batch([pa.array([number], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])
                    number, held = own, np.zeros(part, bool)
                held[at[at // part == own] - own * part] = True
        if number is not None:
            yield pa.record_batch([pa.array([number], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    place = F.pandas_udf(lambda s: pd.Series((_place(s.to_numpy().view(np.uint64), bits) // part).astype(np.int32)), "int")
    dealt = counts.withColumn("part", place("shingle")).repartition("part").sortWithinPartitions("part").select("shingle")
    out = np.zeros(bits // 8, np.uint8)
    for row in dealt.mapInArrow(mark, "part int, bits binary").collect():  # BITS bits in all
        own = np.frombuffer(row["bits"], np.uint8)
        out[row["part"] * len(own) : (row["part"] + 1) * len(own)] |= own
    return out


def _linked(pairs: DataFrame, docs: DataFrame, profile: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """Links (a, b) of classes from pairs (a, b, x, y, spare) of their sets, the most promising first.

    As soon as two classes are of one component, their other pairs need no look.
    """
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("spare"), "x", "y"))
    pairs = settle(pairs.withColumn("rank", rank), "pairs")
    links, bounds = None, [0, *ROUNDS, None]
    for low, high in zip(bounds, bounds[1:]):
        now = pairs.where(F.col("rank") > low) if high is None else pairs.where((F.col("rank") > low) & (F.col("rank") <= high))
        if links is not None:
            tops = settle(connected_components(links), "tops")
            for end in ("a", "b"):
                top = tops.select(F.col("node").alias(end), F.col("label").alias(f"top_{end}"))
                now = now.join(top, end, "left").withColumn(f"top_{end}", F.coalesce(f"top_{end}", end))
            now = now.where("top_a != top_b")
        now = settle(now.select("a", "b", "x", "y"), "tried")
        if now.isEmpty():
            if high is None or pairs.where(F.col("rank") > high).isEmpty():
                break
            continue
        sure = _verified(now.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), docs, profile, k, num, den)
        sure = sure.select(F.col("a").alias("x"), F.col("b").alias("y"))
        fresh = now.join(sure, ["x", "y"]).select("a", "b").distinct()
        links = settle(fresh if links is None else links.unionByName(fresh), "links")
    return links


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component, tie) per row: size of its shingle set, the least id that links of similarity num / den lead to,
    and a hash of the text, which tells rows of one id apart.

    Null and empty texts, and texts without a word, have no shingles and are linked with nothing: their
    component is their own id. A text of fewer than k words has its whole sequence as its only shingle.
    Repeated rows and equal texts are one class. Rows with a null id take part; nulls are ignored for the
    least id, which is null only where all ids of a class are. Other columns are not looked at.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    kind = docs.schema["id"].dataType.simpleString()
    common = common_shingles(docs, k)
    schema = f"id {kind}, tie long, n int, fp long, point binary, coarse binary, keys array<long>"
    profile = settle(docs.mapInArrow(_profile(k, num, den, common), schema), "profile")

    keyed = profile.where(F.col("keys").isNotNull()).select(F.explode("keys").alias("key"), "n", "fp")
    rows = keyed.repartition("key").sortWithinPartitions("key", "n", "fp")
    members = settle(rows.mapInArrow(_shared, "key long, n int, fp long"), "members")
    points = profile.where(F.col("point").isNotNull()).select(_node("n", "fp").alias("node"), "point").dropDuplicates(["node"])

    # first round: with the member of each tree that shares keys most often, the likely middle of a group
    met = members.groupBy("n", "fp").agg(F.count(F.lit(1)).alias("met"))
    weighed = settle(members.join(met, ["n", "fp"]), "weighed")
    head = F.max(F.struct("met", "n", "fp")).alias("head")
    heads = weighed.groupBy("key").agg(head).select("key", F.col("head.n").alias("hn"), F.col("head.fp").alias("hf"))
    star = weighed.join(heads, "key").where(_sizes_fit("n", "hn", num, den)).select(_node("hn", "hf").alias("a"), _node("n", "fp").alias("b"))
    shared = star.where("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys"))
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("keys"), "a"))
    star = shared.withColumn("__best", best).where(F.col("__best") <= TRIED).select("a", "b")
    pairs = settle(_bounded(star, points, num, den), "pairs")
    links = settle(_verified(pairs, docs, profile, k, num, den), "links")
    labels = connected_components(links)

    # second round: classes of trees that hold several
    classes = settle(labels.select("node", "label"), "classes")
    marked = members.select("key", "n", _node("n", "fp").alias("node")).join(classes, "node", "left")
    marked = settle(marked.select("key", "n", "node", F.coalesce("label", "node").alias("class")), "marked")
    open_keys = marked.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x != y").select("key")
    placed = profile.where(F.col("point").isNotNull()).select(_node("n", "fp").alias("node"), "point", "coarse").dropDuplicates(["node"])
    placed = settle(placed.join(classes, "node", "left").select("node", F.coalesce("label", "node").alias("class"), "point", "coarse"), "placed")
    rest = marked.join(open_keys, "key").join(placed.select("node", "coarse"), "node")
    found = settle(_class_pairs(rest, num, den), "class-pairs")
    joins = _linked(_text_pairs(found, placed, num, den), docs, profile, k, num, den)
    if joins is None:
        labels = classes
    else:
        joined = connected_components(joins).select(F.col("node").alias("label"), F.col("label").alias("top"))
        alone = joined.join(classes.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("top").alias("label"))
        labels = classes.join(joined, "label", "left").select("node", F.coalesce("top", "label").alias("label")).unionByName(alone)

    own = profile.select("id", "tie", "n", _node("n", "fp").alias("node"))
    classed = settle(own.join(labels, "node", "left").select("id", "tie", "n", F.coalesce("label", "node").alias("class")), "classed")
    least = classed.where("n > 0").groupBy("class").agg(F.min("id").alias("component"))
    out = classed.join(least, "class", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component"), "tie")
