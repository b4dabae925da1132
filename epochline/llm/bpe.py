"""BPE encoding and decoding by tree concatenation.

A text is encoded in two halves, each in two halves again, down to leaves; two encoded neighbours are
joined by encoding the text around the join anew, in a window that grows until its outer tokens are those
that both sides already have. Leaves that white space splits need no window: a word is encoded alone.

Texts over `split_chars` are dealt out as pieces, cut anywhere, and encoded in parallel tasks. What a piece begins and ends with may
go on in its neighbours: these open ends are joined as a tree, some neighbours at a time, in rounds of tasks.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from epochline.llm.arrow_text import small_batches
from epochline.session import settle

#: Entries of the word cache of a worker.
CACHE = 600_000
#: Words that are encoded together, and signs one of which stands between them: it has to be a token of its own.
TOGETHER, SIGNS = 64, "¤§¶®©±"
#: The rules of a tokenizer by which plain words can be cut into what it encodes, without its normaliser and pattern.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: What a plain word has none of, as none of its signs is composed with another one; and what such a pattern finds in it, lower-case.
OTHER = re.compile(r"[^!-~À-ÿ]|<\|")
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
#: Characters of a text in one piece, longer ones are dealt out; and neighbours that are joined in one round.
SPLIT_CHARS, FAN = 1 << 15, 8
#: A special token may span a join; agreement nearer to it than this many characters doesn't count.
GUARD = 40


def parts(text: str) -> list[str]:
    """The text cut at blanks and line ends; no token ever spans one."""
    return text.replace("\n", " ").replace("\t", " ").split(" ")


@dataclass
class Encoded:
    """Text with its ids and, per token, where it starts and ends in the text (in characters)."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def stored(self) -> dict:
        return {"text": self.text, **{c: getattr(self, c).astype("<i8").tobytes() for c in ("ids", "starts", "ends")}}

    @staticmethod
    def read(row: dict | None) -> Encoded | None:
        return row and Encoded(row["text"], np.frombuffer(row["ids"], "<i8").astype(np.uint32), *(np.frombuffer(row[c], "<i8") for c in ("starts", "ends")))


class Codec:
    """A tokenizer file with a word cache. `leaf_chars` is the longest unsplit run that is encoded in one go."""

    def __init__(self, path: str, leaf_chars: int = 2048):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf_chars = max(4, leaf_chars)
        self.sign = next((c for c in SIGNS if self._apart(c)), None)
        self.cache, self.plain = WordCache(self), Plain.of(self.tokenizer)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _apart(self, sign: str) -> bool:
        one = self._ids(sign)
        return len(one) == 1 and self._ids(f"a {sign} b") == self._ids("a") + one + self._ids("b") and one[0] not in self._ids("a b")

    def leaf(self, text: str) -> Encoded:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        return Encoded(text, np.array(e.ids, np.uint32), at[:, 0], at[:, 1])

    def unsplit(self, text: str) -> Encoded:
        """Ids of a run without white space, by halves."""
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.unsplit(text[:half]), self.unsplit(text[half:]))

    def join(self, left: Encoded, right: Encoded) -> Encoded:
        """The encoding of both texts together."""
        n, k = len(left.text), 24
        text = left.text + right.text
        while True:
            i, j = max(0, len(left.ids) - k), min(len(right.ids), k)
            s = int(left.starts[i]) if i else 0
            e = int(right.ends[j - 1]) if j < len(right.ids) else len(right.text)
            window = self.leaf(text[s : n + e])
            window.starts += s
            window.ends += s
            a, wa = (0, 0) if not i else _agree(left, window, i, 0, 0, n - GUARD)
            b, wb = (len(right.ids), len(window.ids)) if j == len(right.ids) else _agree(right, window, 0, n, n + GUARD, n + e)
            if a is not None and b is not None and wa <= wb:
                return Encoded(
                    text,
                    np.concatenate([left.ids[:a], window.ids[wa:wb], right.ids[b:]]),
                    np.concatenate([left.starts[:a], window.starts[wa:wb], right.starts[b:] + n]),
                    np.concatenate([left.ends[:a], window.ends[wa:wb], right.ends[b:] + n]),
                )
            k *= 2

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = [parts(text) for text in texts]
        self.cache.learn(set().union(*split) if split else set())
        find, join = self.cache.__getitem__, b"".join
        return [join(map(find, words)) for words in split]


class WordCache(dict):
    """Ids of words, encoded when first asked for.

    Half of the words at hand are those that came up last; when they are CACHE / 2, they take the place of the
    other half, so that words in use stay and those that came up once go.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(self) >= CACHE // 2:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def learn(self, words: set[str]) -> None:
        """Encode those of the words that are not at hand, many at a time, as a single word costs the tokenizer mostly setting up."""
        sign, longest = self.codec.sign, self.codec.leaf_chars
        if sign is None:
            return
        older, needed = self.older, words.difference(self)
        for w in [w for w in needed if w in older]:  # a dict would be walked as a whole by intersection()
            self.keep(w, older[w])
        fresh = [w for w in needed.difference(older) if w and len(w) <= longest and sign not in w]
        if self.codec.plain is not None:
            one = {w: w.lower() for w in fresh if w.isascii() and w.isalpha()}
            cut = {w: CUT.findall(w.lower()) for w in fresh if w not in one and not OTHER.search(w)}
            find, join = self.codec.plain.ids(set(one.values()).union(*cut.values())).__getitem__, b"".join
            for w, found in one.items():
                self.keep(w, find(found))
            for w, found in cut.items():
                self.keep(w, join(map(find, found)))
            fresh = [w for w in fresh if w not in one and w not in cut]
        groups = [fresh[k : k + TOGETHER] for k in range(0, len(fresh), TOGETHER)]
        mark = self.codec._ids(sign)[0]
        for group, e in zip(groups, self.codec.tokenizer.encode_batch_fast([f" {sign} ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(ids == mark)
            if len(cuts) == len(group) - 1:
                for word, a, b in zip(group, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]):
                    self.keep(word, ids[a:b].tobytes())

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if len(word) > self.codec.leaf_chars:
                return self.codec.unsplit(word).ids.astype("<u4").tobytes()
            ids = array("I", self.codec._ids(word)).tobytes()
        return self.keep(word, ids)


class Plain:
    """What CUT finds in plain words, encoded by `bare`, the tokenizer's model alone, with blanks between."""

    def __init__(self, bare: Tokenizer):
        self.bare = bare
        symbols = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.symbols = str.maketrans({chr(c): symbols.pre_tokenize_str(chr(c))[0][0] for c in (*range(0x21, 0x7F), *range(0xC0, 0x100))})
        vocabulary = bare.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(bare.model.end_of_word_suffix)]] = True

    @staticmethod
    def of(tokenizer: Tokenizer) -> Plain | None:
        """None for a tokenizer of other rules, or without a token for each sign inside and at the end of a word."""
        rules = json.loads(tokenizer.to_str())
        model, added = rules["model"], rules["added_tokens"]
        if {k: rules[k] for k in RULES} != RULES or model["type"] != "BPE" or not model["end_of_word_suffix"] or model["dropout"] or rules["post_processor"]:
            return None
        if any(t["normalized"] or not t["content"].startswith("<|") or t["lstrip"] or t["rstrip"] for t in added):
            return None
        rules |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "decoder": None}
        plain = Plain(Tokenizer.from_str(json.dumps(rules)))
        signs = "".join(plain.symbols.values())
        return plain if all(c in model["vocab"] and c + model["end_of_word_suffix"] in model["vocab"] for c in signs) else None

    def ids(self, words: set[str]) -> dict[str, bytes]:
        words, out = list(words), {}
        for k in range(0, len(words), 8 * TOGETHER):
            group = words[k : k + 8 * TOGETHER]
            ids = np.array(self.bare.encode_batch_fast([" ".join(group).translate(self.symbols)], add_special_tokens=False)[0].ids, "<u4")
            ends, data = (4 * np.flatnonzero(self.last[ids]) + 4).tolist(), ids.tobytes()
            out.update(zip(group, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        return out


def _agree(side: Encoded, window: Encoded, first: int, shift: int, low: int, high: int) -> tuple[int | None, int | None]:
    """Where the side and the window have the same three tokens at the same places, between two positions of the joined text.

    Returns the number of the middle token in both; it begins where a character and no composed one begins.
    """
    places = {(int(s), int(e), int(t)): w for w, (s, e, t) in enumerate(zip(window.starts, window.ends, window.ids))}
    found = []
    for x in range(first + 1, min(len(side.ids) - 1, first + len(window.ids))):
        keys = [(int(side.starts[y]) + shift, int(side.ends[y]) + shift, int(side.ids[y])) for y in (x - 1, x, x + 1)]
        w = [places.get(key) for key in keys]
        if None in w or w[1] != w[0] + 1 or w[2] != w[1] + 1 or keys[0][1] > keys[1][0] or keys[1][1] > keys[2][0]:
            continue
        if keys[0][0] >= low and keys[2][1] <= high and side.text[int(side.starts[x])] < "̀":
            found.append((x, w[1]))
    return found[len(found) // 2] if found else (None, None)


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, leaf_chars: int = 2048) -> Codec:
    """One codec per worker process and file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores as it is
    if (path, leaf_chars) not in _codecs:
        _codecs[path, leaf_chars] = Codec(path, leaf_chars)
    return _codecs[path, leaf_chars]


def encode_texts(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = 2048, split_chars: int = SPLIT_CHARS
) -> DataFrame:
    """(id, n_tokens, ids) per row; ids are little-endian unsigned 32-bit numbers in one binary value.

    Null and empty texts have no tokens. Repeated rows and null ids stay as they are. Columns other than
    the two named are not looked at, so their names can't clash. `path` is a file that every worker has. Texts over
    `split_chars` are encoded when this is called, as pieces; each different one once.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, leaf_chars)
        for batch in batches:
            ids = own.encode(batch.column(1).to_pylist())
            yield pa.record_batch(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["id", "n_tokens", "ids"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    long = F.char_length("text") > split_chars
    out = rows.where(~long).mapInArrow(direct, f"id {kind}, n_tokens long, ids binary")
    keyed = settle(rows.where(long).select("id", F.sha2("text", 256).alias("key"), "text"), "long")
    joined = _encode_pieces(keyed.select("key", "text").dropDuplicates(["key"]), path, leaf_chars, split_chars)
    return out.unionByName(keyed.select("id", "key").join(joined, "key").drop("key")).withColumnRenamed("id", id_col)


_ENDS = pa.struct([("text", pa.string()), ("ids", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])
_PIECE = pa.schema([("key", pa.string()), ("k", pa.int32()), ("head", _ENDS), ("tail", _ENDS), ("tail_at", pa.int32()), ("place", pa.int64()), ("ids", pa.binary())])
_PIECE_SQL = "key string, k int, head {0}, tail {0}, tail_at int, place long, ids binary".format("struct<text:string,ids:binary,starts:binary,ends:binary>")


@dataclass
class Piece:
    """Neighbouring pieces of a text: what they begin with and, if there is white space in them, what they end with, which may both go on.

    `tail_at` is the number of the piece that the tail begins in.
    """

    head: Encoded
    tail: Encoded | None
    tail_at: int

    def row(self, key: str, k: int) -> dict:
        return {"key": key, "k": k, "head": self.head.stored(), "tail": self.tail and self.tail.stored(), "tail_at": self.tail_at}


def _word_row(key: str, place: int, ids: np.ndarray | bytes) -> dict:
    return {"key": key, "place": place, "ids": ids if isinstance(ids, bytes) else ids.astype("<u4").tobytes()}


def join_pieces(codec: Codec, left: Piece, right: Piece) -> tuple[Piece, tuple[int, np.ndarray] | None]:
    """Two neighbours as one, and the word that ends between them, if one does, with its place among the words of the text."""
    if left.tail is None:
        return Piece(codec.join(left.head, right.head), right.tail, right.tail_at), None
    met = codec.join(left.tail, right.head)
    if right.tail is None:
        return Piece(left.head, met, left.tail_at), None
    return Piece(left.head, right.tail, right.tail_at), (2 * left.tail_at + 2, met.ids)


def _encode_pieces(keyed: DataFrame, path: str, leaf_chars: int, piece: int) -> DataFrame:
    """(key, n_tokens, ids) of long texts: pieces are encoded wherever there is room, and their ends are joined in rounds.

    Words of piece k have place 2k + 1, the word that begins in it and ends in a later one 2k + 2, the first of a text 0.
    """
    starts = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / piece).cast("int"))
    pieces = keyed.select("key", "text", F.explode(starts).alias("k")).select(
        "key", "k", F.substring(F.col("text"), F.col("k") * piece + 1, F.lit(piece)).alias("text")
    )

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_PIECE)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, leaf_chars)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):  # pieces are long
                some = batch.slice(a, 64)
                rows, split = [], [parts(text) for text in some.column(2).to_pylist()]
                inner = own.encode([" ".join(words[1:-1]) for words in split])
                for key, k, words, ids in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), split, inner):
                    tail = own.unsplit(words[-1]) if len(words) > 1 else None
                    rows.append(Piece(own.unsplit(words[0]), tail, k).row(key, k))
                    if ids:
                        rows.append(_word_row(key, 2 * k + 1, ids))
                yield made(rows)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Open ends sorted by (key, k): FAN neighbours become one."""
        own, at, held = codec(path, leaf_chars), None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                piece = Piece(Encoded.read(r["head"]), Encoded.read(r["tail"]), r["tail_at"])
                if at != (r["key"], r["k"] // FAN):
                    if held is not None:
                        rows.append(held.row(*at))
                    at, held = (r["key"], r["k"] // FAN), piece
                    continue
                held, word = join_pieces(own, held, piece)
                if word is not None:
                    rows.append(_word_row(r["key"], *word))
            if rows:
                yield made(rows)
        if held is not None:
            yield made([held.row(*at)])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last word of every text, which end with it."""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows.append(_word_row(r["key"], 0, Encoded.read(r["head"]).ids))
                if r["tail"] is not None:
                    rows.append(_word_row(r["key"], 2 * r["tail_at"] + 2, Encoded.read(r["tail"]).ids))
            yield made(rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids sorted by (key, place): one value per text."""
        key, held = None, []

        def row() -> pa.RecordBatch:
            ids = b"".join(held)
            return pa.record_batch([pa.array([key]), pa.array([len(ids) // 4], pa.int64()), pa.array([ids], pa.binary())], ["key", "n_tokens", "ids"])

        for batch in batches:
            for k, _, ids in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if k != key:
                    if key is not None:
                        yield row()
                    key, held = k, []
                held.append(ids)
        if key is not None:
            yield row()

    level = settle(pieces.repartition("key", "k").mapInArrow(ends, _PIECE_SQL), "pieces")
    words = level.where("place is not null").select("key", "place", "ids")
    most = level.agg(F.max("k")).first()[0] or 0
    while most:
        near = level.where("place is null").repartition("key", F.floor(F.col("k") / FAN)).sortWithinPartitions("key", "k")
        level = settle(near.mapInArrow(together, _PIECE_SQL), "pieces")
        words = words.unionByName(level.where("place is not null").select("key", "place", "ids"))
        most //= FAN
    words = words.unionByName(level.where("place is null").mapInArrow(last, _PIECE_SQL).select("key", "place", "ids"))
    return words.repartition("key").sortWithinPartitions("key", "place").mapInArrow(whole, "key string, n_tokens long, ids binary")


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the text that the ids stand for, special tokens included. Null ids give an empty text."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path).tokenizer
        for batch in batches:
            texts = [own.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(decode, f"id {kind}, decoded string").withColumnRenamed("id", id_col)


def round_trip(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = 2048, split_chars: int = SPLIT_CHARS
) -> DataFrame:
    """(id, n_tokens, ids, decoded): encoding and decoding in one pass over the rows, for digests of both."""
    small_batches(df.sparkSession)
    encoded = encode_texts(df, path, id_col, text_col, leaf_chars, split_chars).withColumnRenamed(id_col, "id")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path).tokenizer
        for batch in batches:
            texts = [own.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], ["id", "n_tokens", "ids", "decoded"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.mapInArrow(decode, f"id {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)
