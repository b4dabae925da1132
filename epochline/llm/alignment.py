"""Alignment of two tokenizers over the same texts, by a monoid of fragments.

Two tokenizations of a text agree where tokens of both end at the same byte; these places cut the text into groups.
A fragment is what a byte range says about it: the tokens up to its first such place, which may belong to a group
that begins before it, the groups closed within it, and the tokens after its last such place, whose group may go on.
Two neighbouring fragments are composed by aligning the open end of one with the open beginning of the other; all
else stays. This is associative, so fragments can be composed in any grouping, as a tree.

Short texts are made of fragments of words, which both tokenizers treat alike wherever they stand: fragments that are
closed at both ends, kept at hand per worker. Long texts are dealt out as byte ranges to tasks. Each tokenizer cuts at the first
place after the boundary that it can't reach across, so the two seldom cut at the same byte. The open parts are
composed in rounds, some neighbours at a time, and what closes on the way is set down at once: no task holds a long text's groups.

How often a pair of ids is linked counts over the whole corpus. Pairs with at least one link in half a million are so few that
their counts are sent to every task; the other pairs' counts are joined.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from epochline.llm.arrow_text import small_batches
from epochline.session import settle

#: Longest text in one piece, in characters; neighbours composed in one round.
SPLIT, FAN = 32_768, 8
#: Words whose fragments a worker keeps, the longest that is kept, and words that are worked out together.
CACHE, CACHED_CHARS, TOGETHER = 400_000, 80, 256
#: A word that is worked out with others, behind a blank or bare: no white space of any kind, and not the sign that stands for a blank.
EASY = re.compile(r" ?[^\s\u180e▁]+")
#: Pairs with at least one in HOT of all links are sent to all tasks; there are HOT of them at most.
HOT = 1 << 19
#: A character that no library takes for white space.
SOLID = r"[^\s\u180e]"
#: Where a text is cut into words: before white space, before and after the last line end of some, and before a blank after a line end.
#: Tokens of the first tokenizer end there whatever stands around, as its pattern gives all white space but the last sign to one
#: token, and only a blank to the word behind it.
CUT = re.compile(rf"(?=[ \n])(?:(?<={SOLID})|(?<=[ \n])(?=\n{SOLID})|(?<=\n)(?= {SOLID}))|(?<=\n)(?={SOLID})")
#: Where its pattern ends a token for certain without white space: where ASCII letters, digits and other signs meet.
SIGNS = r"!-&(-/:-@\[-`{-~"
EDGE = re.compile(
    rf"(?<={SOLID})(?= {SOLID})|(?<=[A-Za-z])(?=[0-9'{SIGNS}])|(?<=[0-9])(?=[A-Za-z'{SIGNS}])|(?<=[{SIGNS}])(?=[A-Za-z0-9])"
)


@dataclass
class Tokens:
    """Tokens of both sides with the places where they end, in bytes from the start of the text."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([x, y]) for x, y in zip(self.parts(), other.parts())))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_end, self.b, self.b_end

    def to(self, place: int) -> Tokens:
        """Tokens that end at the place or before."""
        i, j = np.searchsorted(self.a_end, place, "right"), np.searchsorted(self.b_end, place, "right")
        return Tokens(self.a[:i], self.a_end[:i], self.b[:j], self.b_end[:j])

    def after(self, place: int) -> Tokens:
        i, j = np.searchsorted(self.a_end, place, "right"), np.searchsorted(self.b_end, place, "right")
        return Tokens(self.a[i:], self.a_end[i:], self.b[j:], self.b_end[j:])


NONE = Tokens(*(np.zeros(0, np.int64) for _ in range(4)))


@dataclass
class Groups:
    """Closed groups in order: how they are written, the pairs linked, and numbers of tokens and groups."""

    text: str = ""
    links: bytes = b""
    n_a: int = 0
    n_b: int = 0
    n: int = 0

    def __add__(self, other: Groups) -> Groups:
        text = f"{self.text};{other.text}" if self.n and other.n else self.text or other.text
        return Groups(text, self.links + other.links, self.n_a + other.n_a, self.n_b + other.n_b, self.n + other.n)


@dataclass
class Fragment:
    """A byte range: `head` ends with the first place where both end, `tail` begins after the last one.

    Without such a place (`first` and `last` are None) all tokens are in `head`.
    """

    head: Tokens
    closed: Groups
    tail: Tokens
    first: int | None = None
    last: int | None = None


class Pairs:
    """Pairs of ids as one number each, in as few bytes as hold them."""

    def __init__(self, n_a: int, n_b: int):
        self.n_b = n_b
        self.dtype = np.dtype("<u4" if n_a * n_b <= 1 << 32 else "<u8")

    def codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) * np.uint64(self.n_b) + b.astype(np.uint64)).astype(self.dtype)


def fragment(t: Tokens, pairs: Pairs) -> Fragment:
    """The fragment of neighbouring tokens."""
    cuts = np.intersect1d(t.a_end, t.b_end)
    if not len(cuts):
        return Fragment(t, Groups(), NONE)
    first, last = int(cuts[0]), int(cuts[-1])
    return Fragment(t.to(first), close(t.to(last).after(first), cuts[1:], pairs), t.after(last), first, last)


def close(t: Tokens, cuts: np.ndarray, pairs: Pairs) -> Groups:
    """The groups that end at the cuts, the last of which is the end of all tokens."""
    if not len(cuts):
        return Groups()
    i, j = np.searchsorted(t.a_end, cuts, "right"), np.searchsorted(t.b_end, cuts, "right")
    a, b = t.a.tolist(), t.b.tolist()
    written, x, y = [], 0, 0
    for p, q in zip(i.tolist(), j.tolist()):
        written.append(f"{','.join(map(str, a[x:p]))}|{','.join(map(str, b[y:q]))}")
        x, y = p, q
    if (np.diff(t.a_end) > 0).all() and (np.diff(t.b_end) > 0).all():
        links = pairs.codes(t.a[i - 1], t.b[j - 1])
    else:  # tokens without bytes: several end at one place
        ends = [(np.flatnonzero(t.a_end == c), np.flatnonzero(t.b_end == c)) for c in cuts]
        links = np.concatenate([pairs.codes(np.repeat(t.a[u], len(v)), np.tile(t.b[v], len(u))) for u, v in ends])
    return Groups(";".join(written), links.tobytes(), len(a), len(b), len(cuts))


def compose(left: Fragment, right: Fragment, pairs: Pairs) -> Fragment:
    """The fragment of two neighbouring ranges. Only the open end of one and the open beginning of the other are looked at."""
    met = fragment((left.head if left.first is None else left.tail) + right.head, pairs)
    if met.first is None:
        if left.first is None:
            return met
        return Fragment(left.head, left.closed, met.head, left.first, left.last)
    if left.first is None:
        head, first, closed = met.head, met.first, met.closed
    else:
        head, first = left.head, left.first
        closed = left.closed + close(met.head, np.array([met.first]), pairs) + met.closed
    if right.first is None:
        return Fragment(head, closed, met.tail, first, met.last)
    return Fragment(head, closed + right.closed, right.tail, first, right.last)


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Both:
    """Both tokenizers, with the fragments of words that have come up."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        symbols = byte_symbols()
        n_a = max(self.a.get_vocab().values(), default=-1) + 1
        self.a_bytes = [bytes(symbols[c] for c in t) if t and all(c in symbols for c in t) else t.encode() for t in (self.a.id_to_token(i) or "" for i in range(n_a))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_shown, self.b_shown = ([str(i) for i in range(len(xs))] for xs in (self.a_bytes, self.b_bytes))
        self.a_size, self.b_size = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        self.pairs = Pairs(n_a, len(pieces))
        known = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        #: Two characters that stand side by side in some piece: between any others, nothing is ever merged.
        self.beside = {p[k : k + 2] for p in known for k in range(len(p) - 1)}
        #: A character that is merged with nothing keeps the blank that is put before a text apart from it.
        self.by_edges = not any("\n" in pair for pair in self.beside)
        self.by_words = self.by_edges and not any(pair[1] == "▁" != pair[0] for pair in self.beside)
        self.words = Words(self)

    def tokens_a(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def tokens_b(self, text: str) -> list[int]:
        """Ids of text that begins with a blank."""
        return self.b.encode(text[1:])

    def inner_b(self, text: str) -> list[int] | None:
        """Ids of text that begins anywhere."""
        if text.startswith(" ") and len(text) > 1:
            return self.tokens_b(text)
        ids, size = self.b.encode("\n" + text), 0
        for k, i in enumerate(ids):
            size += len(self.b_bytes[i])
            if size == 2:
                return ids[k + 1 :]
        return None

    def tokens(self, a: list[int], a_start: int, b: list[int], b_start: int) -> Tokens:
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return Tokens(a, a_start + np.cumsum(self.a_size[a]), b, b_start + np.cumsum(self.b_size[b]))

    def spelt(self, a: list[int], a_text: str, b: list[int], b_text: str) -> bool:
        """Whether the tokens' bytes are those of the text."""
        return b"".join([self.a_bytes[i] for i in a]) == a_text.encode() and b"".join([self.b_bytes[i] for i in b]) == b_text.encode()

    def whole(self, text: str) -> Groups | None:
        """All groups of a text or word; None if the tokens don't spell it."""
        a, b = self.tokens_a(text), self.inner_b(text)
        if b is None or not self.spelt(a, text, b, text):
            return None
        return finish(fragment(self.tokens(a, 0, b, 0), self.pairs), self.pairs)

    def words_of(self, text: str) -> list[str]:
        """The words of a blank and the text, as CUT cuts them.

        A word behind a blank is written without it, any other with a line end before it.
        """
        out, gap = [], 0
        if text[-1] not in "\n\u180e" and "\u180e" not in text:
            for k, line in enumerate(text.split("\n")):
                found = line.split(" ")
                if found != line.split() and (line or not k):
                    break  # white space of other kinds
                gap += 1
                if line and k:
                    out += [f"\n{'\n' * (gap - 1)}", "\n\n"] if gap > 1 else ["\n\n"]
                    found[0] = f"\n{found[0]}"
                if line:
                    out += found
                    gap = 0
            else:
                return out
        return [w[1:] if w[0] == " " and EASY.fullmatch(w) else f"\n{w}" for w in CUT.split(" " + text)]

    def groups(self, text: str, words: list[str] | None = None) -> Groups | None:
        """All groups of a blank and the text, None without text or if the tokens don't spell it."""
        if not text:
            return None
        found = list(map(self.words.__getitem__, words or self.words_of(text))) if self.by_words else [None]
        if None in found:  # a normaliser may have changed the word; the whole text tells
            return self.whole(" " + text)
        written, links, n_a, n_b, n = zip(*found)
        return Groups(";".join(written), b"".join(links), sum(n_a), sum(n_b), sum(n))

    def ranges(self, text: str, split: int) -> Iterator[tuple[int, int, str, int, str]]:
        """(number, start and text for the first, start and text for the second tokenizer) of byte ranges of a blank and the text.

        A range ends at the first place after `split` characters that a tokenizer doesn't reach across.
        """
        text = " " + text
        bounds = range(split, len(text), split)
        a_cuts, b_cuts = [0], [0]
        for c in bounds:
            edge = EDGE.search(text, max(c, a_cuts[-1]))
            a_cuts.append(edge.start() if edge else len(text))
            at = max(c, b_cuts[-1])
            while at < len(text) and (not self.by_edges or text[at - 1 : at + 1].replace(" ", "▁") in self.beside):
                at += 1
            b_cuts.append(at)
        a_cuts.append(len(text))
        b_cuts.append(len(text))
        a_byte = b_byte = 0
        for k in range(len(a_cuts) - 1):
            a, b = text[a_cuts[k] : a_cuts[k + 1]], text[b_cuts[k] : b_cuts[k + 1]]
            yield k, a_byte, a, b_byte, b
            a_byte += len(a.encode())
            b_byte += len(b.encode())


class Words(dict):
    """Groups of the words of `Both.words_of`, as plain tuples in the order of `Groups`; None if the tokens don't spell one.

    Half of the words at hand are those that came up last; when they are CACHE / 2, they take the place of the other half.
    """

    def __init__(self, both: Both):
        super().__init__()
        self.both, self.older = both, {}

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def keep(self, word: str, found: tuple | None) -> tuple | None:
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE // 2:
                self.older = {}  # gone before the copy is made
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def __missing__(self, word: str) -> tuple | None:
        if word in self.older:
            return self.keep(word, self.older[word])
        found = self.both.whole(word[1:] if word[0] == "\n" else f" {word}")
        return self.keep(word, found and (found.text, found.links, found.n_a, found.n_b, found.n))

    def learn(self, words: set[str]) -> None:
        """Work out words that are not at hand, many at a time: those behind a blank in one text, and bare ones in a text of lines."""
        older, needed = self.older, words.difference(self)
        for w in [w for w in needed if w in older]:  # a dict would be walked as a whole by intersection()
            self.keep(w, older[w])
        fresh = [w for w in needed.difference(older) if len(w) <= CACHED_CHARS]
        for mark in (" ", "\n"):
            group = [w for w in fresh if (w[0] == "\n") == (mark == "\n") and EASY.fullmatch(w, w[0] == "\n")]
            for k in range(0, len(group), TOGETHER):
                self._learn(group[k : k + TOGETHER], mark)

    def _learn(self, words: list[str], mark: str) -> None:
        own, text = self.both, "".join(words) if mark == "\n" else " " + " ".join(words)
        a, b = own.tokens_a(text), own.inner_b(text)
        if b is None or not own.spelt(a, text, b, text):
            return  # one of them isn't spelt; each is tried by itself when it is asked for
        t = own.tokens(a, 0, b, 0)
        cuts = np.intersect1d(t.a_end, t.b_end, assume_unique=True)
        sizes = np.array([len(w.encode()) + (1 if mark == " " else -1) for w in words])  # without a line end, with a blank
        ends = np.cumsum(sizes + (mark == "\n"))
        first, last = np.searchsorted(cuts, ends - sizes, "right"), np.searchsorted(cuts, ends, "right")
        if (cuts[last - 1] != ends).any() or (ends - sizes)[first == 0].any() or (cuts[first - 1] != ends - sizes)[first > 0].any():
            return
        i, j = np.searchsorted(t.a_end, cuts, "right"), np.searchsorted(t.b_end, cuts, "right")
        links, size = own.pairs.codes(t.a[i - 1], t.b[j - 1]).tobytes(), own.pairs.dtype.itemsize
        written, x, y = [], 0, 0
        shown_a, shown_b = [own.a_shown[n] for n in a], [own.b_shown[n] for n in b]
        for p, q in zip(i.tolist(), j.tolist()):
            written.append(f"{','.join(shown_a[x:p])}|{','.join(shown_b[y:q])}")
            x, y = p, q
        i, j = np.append(0, i), np.append(0, j)
        n_a, n_b = (i[last] - i[first]).tolist(), (j[last] - j[first]).tolist()
        for w, u, v, c, d in zip(words, first.tolist(), last.tolist(), n_a, n_b):
            self.keep(w, (";".join(written[u:v]), links[u * size : v * size], c, d, v - u))


def finish(whole: Fragment, pairs: Pairs) -> Groups:
    """The groups of a fragment that is a whole text: nothing goes on at either end."""
    if whole.first is None:
        return Groups()
    return close(whole.head, np.array([whole.first]), pairs) + whole.closed


_both: dict[tuple[str, str], Both] = {}


def both(a_path: str, b_path: str) -> Both:
    """The tokenizers of a worker process, by their files."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores as it is
    if (a_path, b_path) not in _both:
        _both[a_path, b_path] = Both(a_path, b_path)
    return _both[a_path, b_path]


def forget_words() -> None:
    """Workers are used again by later stages, which need no words and should have their room."""
    for own in _both.values():
        own.words.forget()


_FIRST = [
    ("key", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("links", pa.binary()), ("groups", pa.string()), ("sha256", pa.string()),
    ("k", pa.int32()), ("a_start", pa.int64()), ("a_text", pa.string()), ("b_start", pa.int64()), ("b_text", pa.string()),
]
_OPEN = ["head_a", "head_a_end", "head_b", "head_b_end", "tail_a", "tail_a_end", "tail_b", "tail_b_end"]
_PART = [
    ("key", pa.int64()), ("k", pa.int32()), ("spelt", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), *((c, pa.binary()) for c in _OPEN),
    ("start", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("links", pa.binary()), ("groups", pa.string()),
]


def _schema(fields: list[tuple[str, pa.DataType]], **more: str) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join([*(f"{c} {t}" for c, t in more.items()), *(f"{c} {names[t]}" for c, t in fields)])


def _batch(fields: list[tuple[str, pa.DataType]], rows: list[dict], **more: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([*more.values(), *(pa.array([r.get(c) for r in rows], t) for c, t in fields)], [*more, *(c for c, _ in fields)])


def _open_row(key: int, k: int, f: Fragment, spelt: bool) -> dict:
    arrays = zip(_OPEN, (*f.head.parts(), *f.tail.parts()))
    return {"key": key, "k": k, "spelt": spelt, "first": f.first, "last": f.last, **{c: x.astype("<i8").tobytes() for c, x in arrays}}


def _closed_row(key: int, start: int, g: Groups) -> dict:
    return {"key": key, "start": start, "n_a": g.n_a, "n_b": g.n_b, "n_groups": g.n, "links": g.links, "groups": g.text}


def _read_open(row: dict) -> Fragment:
    arrays = [np.frombuffer(row[c], "<i8") for c in _OPEN]
    return Fragment(Tokens(*arrays[:4]), Groups(), Tokens(*arrays[4:]), row["first"], row["last"])


@dataclass
class Aligned:
    """What `align_texts` finds. `rows`: a row per text (key, id, and its numbers if it is short); `parts`: closed groups."""

    rows: DataFrame
    parts: DataFrame
    pairs: Pairs


def align_texts(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT, keep_groups: bool = False) -> Aligned:
    """Groups and links of both tokenizers over a blank and each text.

    `rows` has key (a number of its own for every row), id, n_a, n_b, n_groups and sha256 (of the groups as
    `a1,a2|b1;a3|b2`) per row of `df`; `parts` has key, start (in bytes), n_a, n_b, n_groups, links (pairs as numbers)
    and groups: short texts have one part, whose groups are kept on request, longer ones several, which follow each
    other by their start.

    Null and empty texts, and those that the tokens of either side don't spell byte for byte, have no tokens: zeros, no part,
    and an empty sha256. Repeated rows are texts of their own; null ids stay. Other columns are not looked at.
    """
    spark = df.sparkSession
    small_batches(spark)
    table = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("key"))
    kind = table.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = both(a_path, b_path)
        for batch in batches:
            rows, which, texts = [], [], batch.column(1).to_pylist()
            words = [own.words_of(t) if t and len(t) <= split and own.by_words else None for t in texts]
            own.words.learn(set().union(*filter(None, words)))
            for x, (text, key) in enumerate(zip(texts, batch.column(2).to_pylist())):
                if len(text) > split:
                    pieces = own.ranges(text, split)
                    rows += [dict(zip(("key", "k", "a_start", "a_text", "b_start", "b_text"), (key, *p))) for p in pieces]
                else:
                    g = own.groups(text, words[x])
                    rows.append({"key": key, "n_a": 0, "n_b": 0, "n_groups": 0, "sha256": ""})
                    if g is not None:
                        digest = hashlib.sha256(g.text.encode()).hexdigest()
                        rows[-1] |= {"n_a": g.n_a, "n_b": g.n_b, "n_groups": g.n, "links": g.links, "sha256": digest, "groups": g.text if keep_groups else None}
                which += [x] * (len(rows) - len(which))
            yield _batch(_FIRST, rows, id=batch.column(0).take(pa.array(which, pa.int64())))

    first = settle(table.mapInArrow(read, _schema(_FIRST, id=kind)), "aligned")
    short = first.where("k is null")
    whole = short.where("links is not null").select("key", F.lit(0).cast("long").alias("start"), "n_a", "n_b", "n_groups", "links", "groups")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = both(a_path, b_path)
        for batch in batches:
            for r in batch.to_pylist():
                a, b = own.tokens_a(r["a_text"]), own.inner_b(r["b_text"])
                spelt = b is not None and own.spelt(a, r["a_text"], b, r["b_text"])
                f = fragment(own.tokens(a, r["a_start"], b, r["b_start"]), own.pairs) if spelt else Fragment(NONE, Groups(), NONE)
                yield _batch(_PART, [_open_row(r["key"], r["k"], f, spelt), *([_closed_row(r["key"], f.first, f.closed)] if f.closed.n else [])])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Open parts sorted by (key, k): FAN neighbours become one, and what closes between them is told at once."""
        own, at, held = both(a_path, b_path).pairs, None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if at != (r["key"], r["k"] // FAN):
                    if held is not None:
                        out.append(_open_row(*at, *held))
                    at, held = (r["key"], r["k"] // FAN), (_read_open(r), r["spelt"])
                    continue
                left, spelt = held
                f = compose(left, _read_open(r), own)
                if f.closed.n:  # what closes begins where the left one's last group ends, or after its first
                    out.append(_closed_row(r["key"], f.first if left.first is None else left.last, f.closed))
                held = Fragment(f.head, Groups(), f.tail, f.first, f.last), spelt and r["spelt"]
            if out:
                yield _batch(_PART, out)
        if held is not None:
            yield _batch(_PART, [_open_row(*at, *held)])

    dealt = first.where("k is not null").select("key", "k", "a_start", "a_text", "b_start", "b_text")
    level = settle(dealt.repartition("key", "k").mapInArrow(pieces, _schema(_PART)), "fragments")
    closed = level.where("k is null")
    last = level.agg(F.max("k")).first()[0] or 0
    while last:
        near = level.where("k is not null").repartition("key", F.floor(F.col("k") / FAN)).sortWithinPartitions("key", "k")
        level = settle(near.mapInArrow(together, _schema(_PART)), "fragments")
        closed = closed.unionByName(level.where("k is null"))
        last //= FAN

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first group of each text, which is all that is still open."""
        own = both(a_path, b_path).pairs
        for batch in batches:
            yield _batch(_PART, [_closed_row(r["key"], 0, finish(_read_open(r), own)) for r in batch.to_pylist()])

    composed = level.where("k is not null")
    heads = composed.where("spelt").mapInArrow(ends, _schema(_PART))
    names = ["key", "start", "n_a", "n_b", "n_groups", "links", "groups"]
    broken = composed.where("not spelt").select("key")
    long = closed.join(broken, "key", "left_anti").select(*names).unionByName(heads.select(*names))
    digests = long.select("key", "start", "groups").repartition("key").sortWithinPartitions("key", "start").mapInArrow(_digests, "key long, sha256 string")
    sums = long.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups"))).join(digests, "key")
    ids = first.where("k = 0").select("key", "id").join(sums, "key", "left")
    filled = ids.select("key", "id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_groups")), F.coalesce("sha256", F.lit("")).alias("sha256"))
    rows = short.select("key", "id", "n_a", "n_b", "n_groups", "sha256").unionByName(filled)
    return Aligned(rows, whole.unionByName(long), both(a_path, b_path).pairs)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by (key, start): the digest of each key's groups, which are never in one place."""
    key, digest = None, None
    for batch in batches:
        for k, groups in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                if key is not None:
                    yield pa.record_batch([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "sha256"])
                key, digest = k, hashlib.sha256(groups.encode())
            else:
                digest.update(b";" + groups.encode())
    if key is not None:
        yield pa.record_batch([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "sha256"])


def pair_counts(found: Aligned) -> DataFrame:
    """(pair, n, best): links per pair of ids over all texts, and whether no pair of the same second id has more.

    A pair is its first id times the size of the second vocabulary, plus its second id.
    """
    pairs = found.pairs

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        kept, size = [], 0

        def tell() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate([x for x, _ in kept]), return_inverse=True)
            n = np.bincount(n, weights=np.concatenate([y for _, y in kept]), minlength=len(code)).astype(np.int64)
            return pa.record_batch([pa.array(code.astype(np.int64)), pa.array(n)], ["pair", "n"])

        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), pairs.dtype)
            kept.append(np.unique(codes, return_counts=True))
            size += len(kept[-1][0])
            if size > 2_000_000:  # tasks hold some millions of counts before they tell them
                yield tell()
                kept, size = [], 0
        if kept:
            yield tell()

    counts = settle(found.parts.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    second = F.col("pair") % pairs.n_b
    most = counts.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    return settle(counts.withColumn("second", second).join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def score_links(found: Aligned, counts: DataFrame) -> DataFrame:
    """(key, n_links, n_best, count_sum) of texts that have links: how many, how many with the best pair of their second id, and the counts of all."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") >= max(1, -(-total // HOT))).toArrow()  # HOT rows at most
    code = np.asarray(hot.column("pair")).astype(found.pairs.dtype)
    order = np.argsort(code)
    code, n, best = code[order], np.asarray(hot.column("n"))[order], np.asarray(hot.column("best"))[order]
    dtype = found.pairs.dtype

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for batch in batches:
            links = batch.column(1).to_pylist()
            sizes = np.array([len(x) // dtype.itemsize for x in links], np.int64)
            codes = np.frombuffer(b"".join(links), dtype)
            row = np.repeat(np.arange(len(links)), sizes)
            at = np.minimum(np.searchsorted(code, codes), max(len(code) - 1, 0))
            known = code[at] == codes if len(code) else np.zeros(len(codes), bool)
            sums = np.zeros(len(links), np.int64)
            np.add.at(sums, row[known], n[at[known]])
            good = np.bincount(row[known][best[at[known]]], minlength=len(links)).astype(np.int64) if len(code) else sums
            rare, ends = codes[~known].astype(np.int64), np.searchsorted(row[~known], np.arange(len(links) + 1))
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes), pa.array(good), pa.array(sums), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare))],
                ["key", "n_links", "n_best", "count_sum", "rare"],
            )

    near = settle(found.parts.select("key", "links").mapInArrow(score, "key long, n_links long, n_best long, count_sum long, rare array<long>"), "scored")
    rare = near.where(F.size("rare") > 0).select("key", F.explode("rare").alias("pair")).groupBy("key", "pair").agg(F.count(F.lit(1)).alias("times")).join(counts, "pair")
    times: Column = F.col("times")
    far = rare.select("key", F.lit(0).cast("long").alias("n_links"), F.when(F.col("best"), times).otherwise(0).cast("long").alias("n_best"), (times * F.col("n")).alias("count_sum"))
    return near.drop("rare").unionByName(far).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")))


def align_documents(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row; see `align_texts`, `pair_counts` and `score_links`."""
    found = align_texts(df, a_path, b_path, id_col, text_col, split)
    scored = score_links(found, pair_counts(found))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.rows.join(scored, "key", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), F.col("sha256").alias("groups_sha256")
    )
