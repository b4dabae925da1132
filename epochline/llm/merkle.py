"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line. A section ends after a blank line, or after a paragraph whose digest says so, which
an edit elsewhere doesn't change. Digests of paragraphs make those of sections, and these the root, so equal
roots mean equal texts and differing branches lead to the edits. Below a paragraph stand short marks of its
pieces (some words, cut where the words say so), by which partly equal paragraphs are compared.

Two trees are compared from the top: equal roots end it, equal sections are passed over, the paragraphs of the others are
held against each other, and only those that differ are looked at mark by mark.

A fingerprint is a string: root|section:paragraph=marks,paragraph=marks|section:...; with all its levels it is about a
third as long as the text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from epochline.llm.arrow_text import U64, Words, small_batches
from epochline.llm.neighbours import map_with_next


def _digest(data: bytes, size: int = 8) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit marks of the pieces of a text, and where each begins. A piece ends after a word whose hash says so, a stop or a line end."""
    words = Words(data, np.array([0, len(data)]))
    if not len(words.hash):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    closes = (words.hash & U64(7)) == U64(0)
    closes |= np.isin(data[words.end - 1], (33, 46, 63))
    gap_end = np.append(words.start[1:], len(data))
    line_ends = np.concatenate([[0], np.cumsum(data == 10)])
    closes |= line_ends[gap_end] > line_ends[words.end]
    starts = np.concatenate([[0], np.flatnonzero(closes[:-1]) + 1])
    order = np.arange(len(words.hash)) - np.repeat(starts, np.diff(np.append(starts, len(words.hash))))
    sums = np.add.reduceat(words.hash * (U64(2) * order.astype(np.uint64) + U64(1)), starts)
    return (sums >> U64(32)).astype(np.uint32), words.start[starts]


@dataclass
class Tree:
    """The root, and per section its digest and the digests of its paragraphs; marks of paragraph k are those from `cut[k]` to `cut[k + 1]`."""

    root: str
    sections: list[tuple[str, list[str]]]
    marks: np.ndarray
    cut: list[int]

    def shown(self) -> str:
        hexed, parts, k = self.marks.astype(">u4").tobytes().hex(), [self.root], 0
        for digest, paragraphs in self.sections:
            shown = [f"{p}={hexed[8 * self.cut[k + i] : 8 * self.cut[k + i + 1]]}" for i, p in enumerate(paragraphs)]
            parts.append(f"{digest}:{','.join(shown)}")
            k += len(paragraphs)
        return "|".join(parts)


def tree(text: str) -> Tree:
    """The Merkle tree of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    marks, at = _marks(np.frombuffer(raw, np.uint8))
    lines = raw.split(b"\n")
    ends = np.cumsum([len(x) + 1 for x in lines])
    sections, digests, wholes = [], [], []

    def close() -> None:
        wholes.append(_digest(b"".join(digests)))
        sections.append((wholes[-1].hex(), [d.hex() for d in digests]))
        digests.clear()

    for line in lines:
        digests.append(_digest(line))
        if digests[-1][0] < 32 or not line.strip():
            close()
    if digests:
        close()
    root = _digest(b"".join(wholes) + len(raw).to_bytes(8, "big"), 16)
    return Tree(root.hex(), sections, marks, [0, *np.searchsorted(at, ends).tolist()])


def parse(print_: str) -> Tree:
    """The tree that a fingerprint shows."""
    root, *parts = print_.split("|")
    sections, marks, cut = [], [], [0]
    for part in parts:
        digest, shown = part.split(":")
        paragraphs = [p.split("=") for p in shown.split(",")]
        sections.append((digest, [p for p, _ in paragraphs]))
        for _, own in paragraphs:
            marks.append(own)
            cut.append(cut[-1] + len(own) // 8)
    return Tree(root, sections, np.frombuffer(bytes.fromhex("".join(marks)), ">u4").astype(np.uint32), cut)


def fingerprint(text: str) -> str:
    return tree(text).shown()


def in_order(a: list[str], b: list[str]) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Places of `a` and of `b` that stay when equal entries are matched in order, and all matches of equal entries.

    The k-th of equal entries of one is matched with the k-th of the other; those that stay are a longest run of
    matches that ascend in both.
    """
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    matches = [(i, places[x].pop()) for i, x in enumerate(a) if places.get(x)]
    tails, ends, before = [], [], [-1] * len(matches)
    for m, (_, j) in enumerate(matches):
        k = bisect_left(tails, j)
        before[m] = ends[k - 1] if k else -1
        tails[k : k + 1] = [j]
        ends[k : k + 1] = [m]
    run, m = [], ends[-1] if ends else -1
    while m >= 0:
        run.append(matches[m])
        m = before[m]
    return [i for i, _ in reversed(run)], [j for _, j in reversed(run)], matches


def compare(a: Tree, b: Tree) -> tuple[float, list[int], list[int]]:
    """Likeness of two texts by their trees, and the numbers of the paragraphs of either that are changed, missing or moved in the other.

    Likeness is twice the marks that both have over all marks, 1 for equal roots only, and 0 where one has none. Sections that stay
    in place are passed over, with all that is below them.
    """
    if a.root == b.root:
        return 1.0, [], []
    stay_a, stay_b, _ = in_order([s for s, _ in a.sections], [s for s, _ in b.sections])

    def opened(t: Tree, stay: list[int]) -> tuple[list[int], list[str], int]:
        held, numbers, digests, passed, k = set(stay), [], [], 0, 0
        for i, (_, paragraphs) in enumerate(t.sections):
            if i in held:
                passed += t.cut[k + len(paragraphs)] - t.cut[k]
            else:
                numbers += range(k, k + len(paragraphs))
                digests += paragraphs
            k += len(paragraphs)
        return numbers, digests, passed

    (own, p, common), (other, q, _) = opened(a, stay_a), opened(b, stay_b)
    stay_p, stay_q, equal = in_order(p, q)
    common += sum(a.cut[own[i] + 1] - a.cut[own[i]] for i, _ in equal)
    differ_p, differ_q = {i for i, _ in equal}, {j for _, j in equal}
    common += _common(_of(a, [k for i, k in enumerate(own) if i not in differ_p]), _of(b, [k for j, k in enumerate(other) if j not in differ_q]))
    total = len(a.marks) + len(b.marks)
    near = min(2 * common / total, 1.0 - 1e-9) if len(a.marks) and len(b.marks) else 0.0
    stay_p, stay_q = set(stay_p), set(stay_q)
    return near, [k for i, k in enumerate(own) if i not in stay_p], [k for j, k in enumerate(other) if j not in stay_q]


def _of(t: Tree, paragraphs: list[int]) -> np.ndarray:
    return np.concatenate([t.marks[t.cut[k] : t.cut[k + 1]] for k in paragraphs]) if paragraphs else t.marks[:0]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Marks that both have, each as often as both have it."""
    if not len(a) or not len(b):
        return 0
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1; see `compare`."""
    return compare(parse(a), parse(b))[0]


def changed_paragraphs(a: str, b: str) -> tuple[list[int], list[int]]:
    """Numbers of the paragraphs of either text that are changed, missing or moved in the other; see `compare`."""
    return compare(parse(a), parse(b))[1:]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) per row. Null is the empty text, which has a fingerprint too; repeated rows stay; other columns are not looked at."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.string())], ["id", "fingerprint"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(build, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its `edited` form with the next text in descending order of the id.

    (id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next, changed, changed_edited). The last two are the
    numbers of the paragraphs of the text and of its edited form that the other lacks in that place. A null text is empty,
    a null id comes last, rows of one id are ordered by a hash of the text. A table of one row is its own next. The id has to
    be numeric.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType
    if not isinstance(kind, NumericType):
        raise TypeError("the next text in the order of an id needs a numeric id")
    names = ["id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "changed", "changed_edited"]
    schema = f"id {kind.simpleString()}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ints = pa.list_(pa.int32())

    def visit(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out))
            made = pa.record_batch([*(pa.array(c) for c in columns[:7]), *(pa.array(c, ints) for c in columns[7:])], names)
            out.clear()
            return made

        for range_, id_, text, extra in rows:
            following = tree(text) if not extra or (held is not None and held[0] == range_ and not held[4]) else None
            if held is not None and held[0] == range_ and not held[4]:
                own, other = held[3], edited(held[2], text)
                changed = tree(other)
                near, *numbers = compare(own, changed)
                out.append((held[1], len(held[2]), other, own.shown(), changed.shown(), near, compare(own, following)[0], *numbers))
                if len(out) == 200:
                    yield batch()
            held = (range_, id_, text, following, extra)
        if out:
            yield batch()

    schema += ", changed array<int>, changed_edited array<int>"
    return map_with_next(df, id_col, text_col, visit, schema).withColumnRenamed("id", id_col)
