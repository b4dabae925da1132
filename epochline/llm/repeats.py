"""Removal of repeated 100-byte strings: suffix-array deduplication by bucket-pointer refinement.

The suffix order matters only as far as it tells which positions agree over `length` bytes, and which of
those comes first. So positions are put into buckets by an initial q-gram, and a bucket is refined by the
bucket identifiers of later offsets: the identifier of 2q bytes at a position comes from those of q bytes
at the position and q further on, and these updates are reused for 4q, 8q and so on.

Two things keep the shuffle small. First, windows that share their least q-gram stand in a run, so the run
is what is bucketed: equal strings have the same least q-gram at the same place. Second, a run is compared
as a whole first. A run that an earlier one equals is settled, one that is alone in its bucket too; the
others, such as those at the ends of a repeat, are refined to shorter runs and at last to single strings.

Identifiers are 64-bit hashes, and strings count as equal if two of them agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochline.llm.arrow_text import BYTE, U64, mix, signed, small_batches, utf8
from epochline.session import release, settle

#: Bytes that are looked at together.
SLICE = 1 << 18
_A, _B, _C, _D = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93)


def _refine(ids: np.ndarray, q: int) -> np.ndarray:
    """Bucket identifiers of 2q bytes from those of q bytes."""
    out = ids[:-q] * _A
    out += ids[q:] * _B
    out ^= out >> U64(29)
    return out


class Grams:
    """Bucket identifiers of the q-grams of a slice, and of twice as many bytes, for windows of `length` bytes.

    q is the greatest power of two up to a third of the length.
    """

    def __init__(self, data: np.ndarray, length: int):
        self.length, self.q = length, 1 << max(0, (length // 3).bit_length() - 1)
        ids, q = BYTE[data], 1
        while q < self.q:
            ids = _refine(ids, q)
            q *= 2
        self.one = ids
        self.two = _refine(ids, q)

    def text(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Identifiers of the bytes lo to hi + length - 1. They hold at most five blocks of 2q."""
        return self.bytes(lo, hi - lo + self.length)

    def bytes(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Identifiers of `size` bytes from lo on, at least 2q of them."""
        block, last = 2 * self.q, lo + size - 2 * self.q
        out = np.asarray(size).astype(np.uint64) + np.zeros(len(lo), np.uint64)
        for k in range(5):
            out = mix(out * _C + self.two[np.minimum(lo + k * block, last)])
        return out

    def string(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two identifiers of each string of `length` bytes."""
        middle = np.minimum(at + 2 * self.q, at + self.length - 2 * self.q)
        last = at + self.length - 2 * self.q
        first, second, third = self.two[at], self.two[middle], self.two[last]
        return mix(first * _C + second * _D + third), mix(first + second * _A + third * _B)

    def runs(self, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each run, and the position of the least q-gram of its windows."""
        n, width = len(self.one) + self.q - 1, self.length - self.q + 1
        keyed = (mix(self.one) & ~U64(0xFFFFFF)) | np.arange(len(self.one), dtype=np.uint64)
        w = 1
        while 2 * w <= width:
            keyed = np.minimum(keyed[:-w], keyed[w:])
            w *= 2
        if w < width:
            keyed = np.minimum(keyed[: w - width], keyed[width - w :])
        least = (keyed & U64(0xFFFFFF)).astype(np.int64)
        windows = n - self.length + 1
        broken = np.zeros(n + 1, np.int32)  # windows that would reach into the next text
        full = np.diff(off) > 0
        np.add.at(broken, np.maximum(off[:-1], off[1:] - self.length + 1)[full], 1)
        np.add.at(broken, off[1:][full], -1)
        whole = np.cumsum(broken)[:windows] == 0
        change = np.ones(windows + 1, bool)
        change[1:-1] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
        lo = np.flatnonzero(change[:-1])
        hi = np.append(lo[1:], windows) - 1
        keep = whole[lo]
        lo, hi = lo[keep], hi[keep]
        return lo, hi, least[lo]


def slices(off: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first byte, first text, offsets) of parts of about SLICE bytes. A longer text is cut; its parts overlap by length - 1."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE, "right")) - 1)
        if off[b] - off[a] <= 2 * SLICE:
            yield int(off[a]), a, off[a : b + 1] - off[a]
        else:
            for s in range(int(off[a]), int(off[b]), SLICE):
                yield s, a, np.array([0, min(SLICE + length - 1, off[b] - s)])
        a = b


OUT = "bucket long, content long, id {id}, place long, n long"
_NAMES = ["bucket", "content", "id", "place", "n"]


def _first_only(batch: pa.RecordBatch, row: np.ndarray, bucket: np.ndarray, content: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """What a batch has to send: of equal runs the first; the others are settled and go as spans with a negative n."""
    ids, tie = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    rank = pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    place = (tie[row] << 32) | lo
    order = np.lexsort((place, rank[row], content, bucket))
    b, c, r, p = bucket[order], content[order], rank[row][order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    again = ~new & ((r != r[head]) | (p != p[head]))
    first, rest = order[new], order[again]
    srow, slo, sn = join_spans(row[rest], lo[rest], n[rest])
    where = np.concatenate([row[first], srow])
    spread = mix(srow.astype(np.uint64) * _A + slo.astype(np.uint64) + U64(batch.num_rows))
    return pa.record_batch(
        [
            signed(np.concatenate([bucket[first], spread])),
            signed(np.concatenate([content[first], np.zeros(len(srow), np.uint64)])),
            ids.take(pa.array(where)),
            pa.array((tie[where] << 32) | np.concatenate([lo[first], slo])),
            pa.array(np.concatenate([n[first], -sn])),
        ],
        _NAMES,
    )


def join_spans(row: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of windows that touch become one."""
    order = np.lexsort((lo, row))
    row, lo, n = row[order], lo[order], n[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] > lo[:-1] + n[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1 if len(row) else at
    return row[at], lo[at], lo[last] + n[last] - lo[at] if len(row) else n


def _initial(length: int):
    """Runs of every text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(2))
            parts = []
            for base, first, local in slices(off, length):
                if local[-1] < length:
                    continue
                grams = Grams(data[base : base + int(local[-1])], length)
                lo, hi, least = grams.runs(local)
                row = np.searchsorted(local, lo, "right") - 1 + first
                parts.append((row, mix(grams.one[least]), mix(grams.text(lo, hi) + (least - lo).astype(np.uint64) * _D), lo + base - off[row], hi - lo + 1))
            if parts:
                yield _first_only(batch, *(np.concatenate(x) for x in zip(*parts)))

    return build


def _finer(length: int, width: int):
    """The runs that are still open, cut where the distance to their least q-gram is a multiple of `width`; single strings for 1."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(2))
            lists = batch.column(3)
            counts = np.diff(np.asarray(lists.offsets))
            of = np.repeat(np.arange(len(counts)), counts)
            flat = lists.flatten()
            starts, sizes = (np.asarray(flat.field(k)).astype(np.int64) for k in ("lo", "n"))
            parts = []
            for x in range(len(counts)):
                mine = np.flatnonzero(of == x) if len(counts) < 8 else np.arange(np.searchsorted(of, x), np.searchsorted(of, x, "right"))
                text = data[off[x] : off[x + 1]]
                for k in mine:  # only the bytes around an open run are looked at again
                    lo, n = int(starts[k]), int(sizes[k])
                    parts.append((x, lo, n, text[lo : lo + n + length - 1]))
            if not parts:
                continue
            row = np.array([p[0] for p in parts])
            base = np.array([p[1] for p in parts])
            size = np.array([p[2] for p in parts])
            joined = np.concatenate([p[3] for p in parts])
            begin = np.cumsum(np.concatenate([[0], size + length - 1]))
            found = []
            for a in range(0, len(parts), 2000):
                b = min(a + 2000, len(parts))
                grams = Grams(joined[begin[a] : begin[b]], length)
                at = np.repeat(begin[a:b] - begin[a], size[a:b]) + _ranges(size[a:b])
                owner = np.repeat(np.arange(a, b), size[a:b])
                offset = _ranges(size[a:b])
                if width == 1:
                    one, two = grams.string(at)
                    found.append((row[owner], one, two, base[owner] + offset, np.ones(len(at), np.int64)))
                    continue
                lo, hi, least = grams.runs(begin[a : b + 1] - begin[a])
                # the least q-gram of a run stands `least - window` behind its windows
                gap = np.repeat(least, hi - lo + 1) - at
                cut = np.ones(len(at), bool)
                cut[1:] = (gap[1:] // width != gap[:-1] // width) | (owner[1:] != owner[:-1])
                s = np.flatnonzero(cut)
                e = np.append(s[1:], len(at)) - 1
                # all windows of a cut hold the same `core` bytes, so equal strings are in one bucket of cores
                core, turn = length - width + 1, gap[s] // width
                key = grams.bytes(at[s] + gap[s] - turn * width, core) if core >= 2 * grams.q else grams.one[at[s] + gap[s]]
                key = mix(key + turn.astype(np.uint64))
                content = mix(grams.text(at[s], at[e]) + gap[s].astype(np.uint64) * _D)
                found.append((row[owner[s]], key, content, base[owner[s]] + offset[s], e - s + 1))
            yield _first_only(batch, *(np.concatenate(x) for x in zip(*found)))

    return build


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 of every size in a row."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by bucket, content, id and place: settled spans, and runs that are first of their kind in a bucket of several kinds.

    Holds one run at a time, however large a bucket is.
    """
    bucket = content = None
    head, kinds, pending = None, 0, None
    for batch in batches:
        b, c, place, n = (np.asarray(batch.column(k)) for k in (0, 1, 3, 4))
        ids = batch.column(2)
        size = len(b)
        if not size:
            continue
        spans = n < 0
        new_bucket, new_kind = np.ones(size, bool), np.ones(size, bool)
        new_bucket[1:] = b[1:] != b[:-1]
        new_kind[1:] = new_bucket[1:] | (c[1:] != c[:-1])
        if bucket is not None and b[0] == bucket:
            new_bucket[0] = False
            new_kind[0] = c[0] != content
        rank = pc.rank(ids, tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64)
        at = np.maximum.accumulate(np.where(new_kind, np.arange(size), -1))
        same = (rank == rank[at]) & (place == place[at])
        if (at < 0).any():  # goes on from the batch before
            k = int((at < 0).sum())
            equal = np.array([ids[i].as_py() == head[0] for i in np.flatnonzero(place[:k] == head[1])], bool)
            same[:k] = False
            same[np.flatnonzero(place[:k] == head[1])] = equal
        settled = ~spans & ~new_kind & ~same
        group = np.cumsum(new_bucket)  # 0: the bucket that was open
        count = np.bincount(group, weights=new_kind, minlength=group[-1] + 1).astype(np.int64)
        count[0] += kinds
        first = np.flatnonzero(new_kind & ~spans)
        several = count[group[first]] > 1
        out = [pa.record_batch([ids.filter(pa.array(spans)), pa.array(place[spans]), pa.array(-n[spans]), pa.array(np.ones(int(spans.sum()), bool))], _JUDGED)]
        out.append(pa.record_batch([ids.filter(pa.array(settled)), pa.array(place[settled]), pa.array(n[settled]), pa.array(np.ones(int(settled.sum()), bool))], _JUDGED))
        chosen = first[several]
        out.append(pa.record_batch([ids.take(pa.array(chosen)), pa.array(place[chosen]), pa.array(n[chosen]), pa.array(np.zeros(len(chosen), bool))], _JUDGED))
        if pending is not None and count[0] > 1:
            out.append(pending)
        if group[-1] > 0 or count[0] > 1:
            pending = None
        alone = first[(~several) & (group[first] == group[-1])]
        if len(alone):
            i = int(alone[-1])
            pending = pa.record_batch([ids.slice(i, 1), pa.array(place[i : i + 1]), pa.array(n[i : i + 1]), pa.array([False])], _JUDGED)
        kinds = int(count[-1])
        bucket, content = b[-1], c[-1]
        if at[-1] >= 0:
            head = (ids[int(at[-1])].as_py(), place[at[-1]])
        yield from (x for x in out if x.num_rows)


_JUDGED = ["id", "place", "n", "settled"]
_LOW = 0xFFFFFFFF


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """Rows (id, tie, spans): per text the spans (lo, n) of windows whose string of `length` bytes also starts earlier.

    `tie` is half the CRC of the text and tells texts of one id apart. Texts without repeats are left out.
    """
    small_batches(df.sparkSession)
    texts = _keyed(df, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    return _gather(_settled(texts, kind, length), settled=True)


def _keyed(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = [F.struct(*carry).alias("carried")] if carry else []
    return df.select(F.col(id_col).alias("id"), F.shiftright(F.crc32(text), 1).alias("tie"), text.alias("text"), *carried)


def _gather(found: DataFrame, settled: bool) -> DataFrame:
    """Spans per text; there are at most as many as the text has bytes."""
    lo = F.col("place").bitwiseAND(F.lit(_LOW)).alias("lo")
    return (
        found.where(F.col("settled") == settled)
        .groupBy("id", F.shiftright("place", 32).alias("tie"))
        .agg(F.collect_list(F.struct(lo, "n")).alias("spans"))
    )


def _settled(texts: DataFrame, kind: str, length: int) -> DataFrame:
    """(id, place, n, settled) after all refinements; only settled rows count."""

    def judged(runs: DataFrame) -> DataFrame:
        sorted_runs = runs.repartition("bucket").sortWithinPartitions("bucket", "content", "id", "place")
        return sorted_runs.mapInArrow(_judge, f"id {kind}, place long, n long, settled boolean")

    found = settle(judged(texts.mapInArrow(_initial(length), OUT.format(id=kind))), "runs")
    release(texts.sparkSession)
    everything = found
    for width in (8, 1):
        open_runs = _gather(found, settled=False)
        again = texts.alias("t").join(open_runs.alias("o"), _same_text()).select("t.id", "t.tie", "t.text", "o.spans")
        found = settle(judged(again.mapInArrow(_finer(length, width), OUT.format(id=kind))), "finer")
        release(texts.sparkSession)
        everything = everything.unionByName(found)
    return everything


def _same_text():
    return F.col("t.id").eqNullSafe(F.col("o.id")) & (F.col("t.tie") == F.col("o.tie"))


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, carry: tuple[str, ...] = (), as_text: bool = False
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, removed, kept) per row; with `carry` also a struct `carried` of these columns.

    Removes each byte that a string of `length` bytes covers which also starts earlier: in a text of smaller
    id, or in the same text further left. `removed` lists the removed spans as (start, end) in bytes, `kept`
    the bytes that remain; `as_text` makes them a string without the characters that a cut has split. Null and empty texts have 0 bytes. A null id comes before all others. Rows that
    repeat an id and its text count as one document and get the same result; different texts of one id are
    ordered by their CRC. Other columns are not looked at.
    """
    small_batches(df.sparkSession)
    texts = _keyed(df, id_col, text_col, carry)
    kind = texts.schema["id"].dataType.simpleString()
    spans = _gather(_settled(texts.drop("carried"), kind, length), settled=True)
    joined = texts.alias("t").join(spans.alias("o"), _same_text(), "left").select("t.id", "t.text", "o.spans", *(["t.carried"] if carry else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            lists = batch.column(2)
            flat = lists.flatten()
            lo, n = (np.asarray(flat.field(k)).astype(np.int64) for k in ("lo", "n"))
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).astype(np.int64)
            removed, kept = [], []
            for x in range(batch.num_rows):
                text = data[off[x] : off[x + 1]]
                a, b = bounds[x], bounds[x + 1]
                if a == b:
                    removed.append([])
                    kept.append(text.tobytes())
                    continue
                _, start, size = join_spans(np.zeros(b - a, np.int64), *_covered(lo[a:b], n[a:b] + length - 1))
                removed.append([{"start": int(s), "end": int(s + k)} for s, k in zip(start, size)])
                edge = np.zeros(len(text) + 1, np.int32)
                edge[start] += 1
                edge[start + size] -= 1
                kept.append(text[np.cumsum(edge)[:-1] == 0].tobytes())
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(np.diff(off)),
                    pa.array([sum(s["end"] - s["start"] for s in r) for r in removed], pa.int64()),
                    pa.array([len(r) for r in removed], pa.int64()),
                    pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([x.decode(errors="ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
                    *batch.columns[3:],
                ],
                ["id", "n_bytes", "n_removed", "n_spans", "removed", "kept", *batch.schema.names[3:]],
            )

    out = f"id {kind}, n_bytes long, n_removed long, n_spans long, removed array<struct<start:long,end:long>>, kept {'string' if as_text else 'binary'}"
    if carry:
        out += f", carried {texts.schema['carried'].dataType.simpleString()}"
    return joined.mapInArrow(cut, out).withColumnRenamed("id", id_col)


def _covered(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans by start, none of which ends before an earlier one."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate((lo + n)[order])
    return lo, end - lo
