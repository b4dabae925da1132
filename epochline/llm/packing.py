"""Packing documents into sequences of bounded length by linear grouping.

Lengths are whole numbers up to the capacity, so all that a packing has to know is how many pieces there are of
each length: a table of at most `capacity` rows, whatever the corpus. On that table the large lengths are dealt to
groups of equal cardinality, and each is rounded up to the greatest of its group. For the few sizes that remain, a
linear programme over configurations (what one sequence can hold) is solved by column generation; its whole parts
say how many sequences take which configuration. Actual lengths take the places of the rounded ones; sequences in which they leave much
room are given up. Small pieces and what is left of the large ones go by best fit, in decreasing order, where least room stays.

The result is a plan of a few thousand rows: the pieces of one length from one number on go to consecutive sequences,
so many to each, from some offset on. Pieces get their number within their length in two passes: a count per
task and length, and a running sum of these counts. No piece is moved for it, and none passes through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochline.llm.arrow_text import small_batches
from epochline.llm.bpe import SPLIT_CHARS, codec, encode_texts
from epochline.session import settle, sized

#: Groups of large lengths, and the share of the capacity from which on a length is large.
GROUPS, LARGE = 32, 0.16
#: How full actual pieces make the sequences of a configuration at least; others are left to best fit, which does better there.
FULL = 0.99


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size so that the worth is greatest and the sizes fit."""
    best, history = np.zeros(capacity + 1), []
    for size, value in zip(sizes.tolist(), worth.tolist()):
        history.append(best)
        if value <= 0:
            continue
        best = best.copy()
        for times in range(1, capacity // size + 1):
            np.maximum(best[times * size :], history[-1][: capacity + 1 - times * size] + times * value, out=best[times * size :])
    taken, room, value = np.zeros(len(sizes), np.int64), capacity, best[capacity]
    for k in range(len(sizes) - 1, -1, -1):
        while value > history[k][room] + 1e-12:
            taken[k] += 1
            room -= int(sizes[k])
            value -= worth[k]
    return taken


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1000) -> list[tuple[np.ndarray, int]]:
    """(how many of each size a sequence holds, how many such sequences), the whole part of an optimal fractional packing.

    Revised simplex over configurations that a knapsack finds as they are needed.
    """
    basis = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = knapsack(sizes, price, capacity)
        if price @ column <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        amount = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
    return [(np.rint(basis[:, j]).astype(np.int64), int(np.floor(x + 1e-6))) for j, x in enumerate(amount) if x >= 1 - 1e-6]


@dataclass
class Plan:
    """Where pieces go: from `rank` on, pieces of a length go to sequences from `bin` on, `per` to each, from `offset` on."""

    capacity: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    bins: int = 0
    #: Sequences by the room they have left, as ranges of their numbers; and the same as bits.
    free: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    rooms: int = 0

    def leave(self, room: int, first: int, last: int) -> None:
        if room and last > first:
            self.free.setdefault(room, []).append((first, last))
            self.rooms |= 1 << room

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A range of sequences with the least room that is enough."""
        bits = self.rooms >> least
        if not bits:
            return None
        room = least + (bits & -bits).bit_length() - 1
        first, last = self.free[room].pop()
        if not self.free[room]:
            self.rooms &= ~(1 << room)
        return room, first, last

    def fit(self, length: int, rank: int, end: int) -> None:
        """Pieces of one length, from `rank` to `end`, by best fit."""
        while rank < end:
            found = self.take(length)
            if found is None:
                count = -(-(end - rank) // (self.capacity // length))
                found = self.capacity, self.bins, self.bins + count
                self.bins += count
            room, first, last = found
            per = room // length
            whole = min(last - first, (end - rank) // per)
            offset = self.capacity - room
            if whole:
                self.rows.append((length, rank, first, per, offset))
                rank += whole * per
                self.leave(room - per * length, first, first + whole)
            if rank < end and first + whole < last:  # one that not all fill
                self.rows.append((length, rank, first + whole, per, offset))
                self.leave(room - (end - rank) * length, first + whole, first + whole + 1)
                rank, whole = end, whole + 1
            self.leave(room, first + whole, last)

    def substitute(self, slots: list[tuple[int, int]], supply: list[Supply], count: int) -> list[tuple[int, int, int]]:
        """`count` sequences of a configuration, (group, how many of it); actual pieces come from the supply of each group.

        Sequences that actual pieces fill less than FULL, because rounding hid room, are not made: their pieces are returned.
        """
        taken, back = [supply[g].take(count) for g, n in slots for _ in range(n)], []
        cuts = sorted({0, count}.union(*({at for at, _, _ in slot} for slot in taken)))
        for a, b in zip(cuts, cuts[1:]):
            here = [next(s for s in reversed(slot) if s[0] <= a) for slot in taken]
            if sum(length for _, length, _ in here) < FULL * self.capacity:
                back += [(length, rank + a - at, rank + b - at) for at, length, rank in here]
                continue
            offset = 0
            for at, length, rank in here:
                self.rows.append((length, rank + a - at, self.bins, 1, offset))
                offset += length
            self.leave(self.capacity - offset, self.bins, self.bins + b - a)
            self.bins += b - a
        return back

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(sorted(self.rows), np.int64).reshape(-1, 5).T)


class Supply:
    """Pieces of a group by decreasing length: (length, first number, number after the last)."""

    def __init__(self, ranges: list[tuple[int, int, int]]):
        self.ranges = list(reversed(ranges))

    def take(self, count: int) -> list[tuple[int, int, int]]:
        """The next `count` pieces as (place among them, length, number within the length)."""
        out, at = [], 0
        while at < count:
            length, a, b = self.ranges.pop()
            n = min(count - at, b - a)
            out.append((at, length, a))
            at += n
            if a + n < b:
                self.ranges.append((length, a + n, b))
        return out


def linear_groups(pieces: list[tuple[int, int, int]], groups: int) -> list[list[tuple[int, int, int]]]:
    """Ranges of pieces (length, first number, after the last) by decreasing length, in groups of equal cardinality.

    Groups whose greatest length is the same are one.
    """
    total = sum(b - a for _, a, b in pieces)
    ends = [total * (g + 1) // groups for g in range(groups)]
    out: list[list[tuple[int, int, int]]] = []
    at, g, fresh = 0, 0, True
    for length, first, last in sorted(pieces, reverse=True):
        while first < last:
            while at >= ends[g]:
                g, fresh = g + 1, True
            if fresh and not (out and out[-1][0][0] == length):
                out.append([])
            fresh = False
            n = min(last - first, ends[g] - at)
            out[-1].append((length, first, first + n))
            first, at = first + n, at + n
    return out


def plan_packing(counts: dict[int, int], capacity: int, groups: int = GROUPS, large: float = LARGE) -> Plan:
    """The packing of `counts` pieces per length, each from 1 to `capacity`. What it costs is bounded by the capacity."""
    plan = Plan(capacity)
    least = max(1, int(capacity * large))
    rest = [(s, 0, n) for s, n in counts.items() if n and s >= least]
    grouped = linear_groups(rest, groups)
    if grouped:
        supply, back = [Supply(g) for g in grouped], []
        sizes, demand = np.array([[g[0][0], sum(b - a for _, a, b in g)] for g in grouped], np.int64).T
        for config, count in configurations(sizes, demand, capacity):
            left = [sum(b - a for _, a, b in s.ranges) for s in supply]
            count = min([count, *(left[k] // n for k, n in enumerate(config.tolist()) if n)])
            if count > 0:
                back += plan.substitute([(k, int(n)) for k, n in enumerate(config) if n], supply, count)
        rest = back + [r for s in supply for r in s.ranges]
    for length, a, b in sorted(rest + [(s, 0, n) for s, n in counts.items() if s < least], reverse=True):
        plan.fit(length, a, b)
    return plan


_PIECE = "piece int, start long, length int, ids_crc32 long, part int, nth long"


def cut_pieces(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, part, nth[, ids]); `nth` numbers the pieces of a length within a task, `part`.

    Texts are encoded and cut in one pass; only those that `bpe.encode_texts` deals out to tasks are encoded before.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def cut(ids_of: Callable[[pa.Array], list[bytes]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
            for batch in batches:
                whole = [x + end for x in ids_of(batch.column(1))]
                sizes = np.array([len(x) // 4 for x in whole], np.int64)
                number = -(-sizes // capacity)
                row = np.repeat(np.arange(len(whole)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                pieces = [whole[r][4 * a : 4 * b] for r, a, b in zip(row.tolist(), start.tolist(), (start + length).tolist())]
                order = np.argsort(length, kind="stable")
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - np.searchsorted(length[order], length[order])
                nth += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [
                    batch.column(0).take(pa.array(row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int32()),
                    pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
                    pa.array(np.full(len(row), part), pa.int32()),
                    pa.array(nth, pa.int64()),
                    *([pa.array(pieces, pa.binary())] if keep_ids else []),
                ]
                yield pa.record_batch(columns, ["id", "piece", "start", "length", "ids_crc32", "part", "nth", *(["ids"] if keep_ids else [])])

        return run

    schema = f"id {kind}, {_PIECE}{', ids binary' if keep_ids else ''}"
    dealt = F.char_length("text") > SPLIT_CHARS
    short = rows.where(~F.coalesce(dealt, F.lit(False))).mapInArrow(cut(lambda texts: codec(path).encode([t or "" for t in texts.to_pylist()])), schema)
    long = encode_texts(rows.where(dealt), path, "id", "text", split_chars=SPLIT_CHARS).select("id", "ids")
    return short.unionByName(long.mapInArrow(cut(lambda ids: ids.to_pylist()), schema))


def pack_documents(
    df: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    groups: int = GROUPS,
    large: float = LARGE,
    keep_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) per piece of a document.

    A document is its ids and `end_id`. One of more than `capacity` ids is cut into pieces of `capacity`, the last of
    which may be shorter; no other is cut. Pieces lie in a sequence without gaps from offset 0 on.

    Null and empty texts are documents of one id. Repeated rows are documents of their own; null ids stay. An empty
    table has no pieces. Other columns are not looked at. A text is encoded as `bpe.encode_texts` does it.
    """
    small_batches(df.sparkSession)
    pieces = settle(cut_pieces(df, path, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    counts = settle(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length at most
    length, rank, first, per, offset = plan_packing(totals, capacity, groups, large).arrays()
    bits = max([1, *totals.values()]).bit_length()
    if bits + int(capacity).bit_length() > 62:
        raise ValueError("too many pieces of one length to number them")
    at = (length << bits) + rank

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sized(counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    numbered = pieces.join(base, ["length", "part"]).withColumn("nth", F.col("base") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, nth = (np.asarray(batch.column(c), np.int64) for c in ("length", "nth"))
            k = np.searchsorted(at, (size << bits) + nth, "right") - 1
            behind = nth - rank[k]
            sequence = pa.array(first[k] + behind // per[k])
            where = pa.array(offset[k] + behind % per[k] * size)
            names = ["id", "piece", "start", "length", "ids_crc32"]
            columns = [*(batch.column(c) for c in names), sequence, where, *([batch.column("ids")] if keep_ids else [])]
            yield pa.record_batch(columns, [*names, "sequence_id", "offset", *(["ids"] if keep_ids else [])])

    kind = numbered.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long{', ids binary' if keep_ids else ''}"
    return numbered.mapInArrow(place, schema).withColumnRenamed("id", id_col)


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths) from pieces with their ids: the sequences that training reads. A sequence has at most `capacity` ids."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("pieces"))
    joined = F.aggregate("pieces", F.lit(b""), lambda s, p: F.concat(s, p.ids))
    return rows.select("sequence_id", joined.alias("ids"), F.col("pieces.length").alias("lengths"))
