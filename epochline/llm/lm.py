"""A bigram language model in a log-frequency Bloom filter.

Counts are quantised to levels, 1 + floor(log2 count), and an n-gram of level q is in the filter with the
marks 1 to q. To read a count, the marks are probed in turn until one is missing; a false hit raises a level
only if all marks before are there too. The filter comes in segments by the hash of the n-gram, each made
where its n-grams meet. Small enough, all segments go to all workers; otherwise the probes go to the
segments.

The model has a Dirichlet prior: P(w|h) = (c(hw) + M * P(w)) / (c(h) + M) with P(w) = (c(w) + 1) / (N + V + 1),
all counts read from the filter.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochline.llm.arrow_text import U64, Words, chunks, mix, signed, small_batches, utf8
from epochline.session import release, settle

#: Bits per mark and probes per mark: about one false hit in forty.
BITS, PROBES = 8, 4
#: Counted n-grams in a segment, about.
SEGMENT = 1_000_000
#: Share of all tokens from which on a word's exact count goes to all workers, which bounds these words by five million at any size; the others are joined.
TOP_SHARE = 2e-7
#: Bytes of a filter that goes to all workers at most.
RESIDENT = 256 << 20
#: Parts of the texts that ask one after the other where it doesn't, each with a share of the disk.
TURNS = 4
#: Weight of the prior, in words.
PRIOR = 20.0
_END, _BEGIN = U64(0xA076_1D64_78BD_642F), U64(0xE703_7ED1_A0B4_28DB)
_PAIR, _WORD = U64(0x8EBC6AF09C88C6E3), U64(0x1D8E4E27C47D124F)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, token before, text) of every text: its words and one end; the first token follows a beginning."""
    words = Words(data, off)
    counts = np.diff(words.first)
    first = words.first[:-1] + np.arange(len(counts))
    token = np.empty(len(words.hash) + len(counts), np.uint64)
    row = np.repeat(np.arange(len(counts)), counts + 1)
    ends = first + counts
    token[ends] = _END
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = words.hash
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first] = _BEGIN
    return token, before, row


def pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + token)


def word_key(token: np.ndarray) -> np.ndarray:
    return mix(token ^ _WORD)


def segment_of(key: np.ndarray, segments: int) -> np.ndarray:
    return ((key >> U64(40)) % U64(segments)).astype(np.int64)


def level_of(count: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; level 0 is count 0."""
    top = np.power(2.0, level)
    return np.where(level > 0, (top / 2 + top - 1) / 2, 0.0)


def _hashes(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(key + U64(level * 0x9E3779B97F4A7C15 & 2**64 - 1))
    return x >> U64(32), (x & U64(0xFFFFFFFF)) | U64(1)


def _bit(one: np.ndarray, two: np.ndarray, probe: int, size: np.ndarray) -> np.ndarray:
    """Place of a probe among `size` bits, fewer than 2**32."""
    return ((((one + U64(probe) * two) & U64(0xFFFFFFFF)) * size.astype(np.uint64)) >> U64(32)).astype(np.int64)


def build_segment(key: np.ndarray, count: np.ndarray) -> bytes:
    """The bits of one segment, and their number."""
    level = level_of(count)
    size = max(64, int(level.sum()) * BITS)
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        one, two = _hashes(key[level >= q], q)
        for p in range(PROBES):
            bits[_bit(one, two, p, np.array([size]))] = True
    return np.packbits(bits, bitorder="little").tobytes() + size.to_bytes(8, "little")


class Filter:
    """Segments to probe."""

    def __init__(self, segments: dict[int, bytes], total: int):
        self.total = total
        self.size = np.full(total, 64, np.int64)
        self.base = np.zeros(total, np.int64)
        parts, at = [np.zeros(8, np.uint8)], 8  # a segment without n-grams has no bits set
        for s, data in sorted(segments.items()):
            self.size[s] = int.from_bytes(data[-8:], "little")
            self.base[s] = at * 8
            parts.append(np.frombuffer(data[:-8], np.uint8))
            at += len(data) - 8
        self.bits = np.concatenate(parts)

    def levels(self, key: np.ndarray) -> np.ndarray:
        """The level of every n-gram; 0 for those that the filter doesn't hold."""
        level = np.zeros(len(key), np.int64)
        segment = segment_of(key, self.total)
        open_ = np.arange(len(key))
        q = 1
        while len(open_):
            one, two = _hashes(key[open_], q)
            for p in range(PROBES):
                own = segment[open_]
                bit = self.base[own] + _bit(one, two, p, self.size[own])
                hit = (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                open_, one, two = open_[hit], one[hit], two[hit]
            level[open_] = q
            q += 1
        return level


@dataclass
class LanguageModel:
    #: (hash, n) of every training word and the end.
    vocabulary: DataFrame
    #: (segment, bits)
    segments: DataFrame
    n_segments: int
    filter_bytes: int
    n_tokens: int
    n_words: int


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8(column)
    parts = [tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])[:2] for a, b in chunks(off, 1 << 19)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64),) * 2


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch its distinct words, the end and the beginning, with their numbers."""
    for batch in batches:
        token, before = _tokens(batch.column(0))
        word, n = np.unique(token, return_counts=True)
        starts = int((before == _BEGIN).sum())
        yield pa.record_batch([signed(np.append(word, _BEGIN)), pa.array(np.append(n, starts))], ["hash", "n"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the keys of its distinct pairs with their numbers."""
    for batch in batches:
        token, before = _tokens(batch.column(0))
        key, n = np.unique(pair_key(before, token), return_counts=True)
        yield pa.record_batch([signed(key), pa.array(n)], ["key", "n"])


def fit_model(df: DataFrame, text_col: str = "text") -> LanguageModel:
    """Counts over all texts; a null text is empty and teaches its end. An empty table gives a model without n-grams."""
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(F.col(text_col).alias("text"))
    vocabulary = settle(texts.mapInArrow(_words, "hash long, n long").where("n > 0").groupBy("hash").agg(F.sum("n").alias("n")), "vocabulary")
    begin = int(np.array([_BEGIN]).view(np.int64)[0])
    n_tokens, n_words = vocabulary.where(F.col("hash") != begin).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    segments = max(8, -(-2 * n_tokens // SEGMENT))

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([signed(word_key(np.asarray(batch.column(0)).view(np.uint64))), batch.column(1)], ["key", "n"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits of each segment, which has about SEGMENT rows."""
        for segment, key, n in _by_segment(batches, segments):
            order = np.argsort(key)
            key, n = key[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            data = build_segment(key[at].view(np.uint64), np.add.reduceat(n, at))
            yield pa.record_batch([pa.array([segment], pa.int32()), pa.array([data], pa.binary())], ["segment", "bits"])

    rows = texts.mapInArrow(_pairs, "key long, n long")
    rows = rows.unionByName(vocabulary.select("hash", "n").mapInArrow(singles, "key long, n long"))
    segment = F.expr(f"shiftrightunsigned(key, 40) % {segments}")
    made = settle(rows.repartition(segment).sortWithinPartitions(segment).mapInArrow(bits, "segment int, bits binary"), "filter")
    size = made.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    return LanguageModel(vocabulary, made, segments, size, n_tokens, n_words)


def _by_segment(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Keys and counts of each segment, from rows sorted by segment."""
    segment, held = None, []
    for batch in batches:
        key, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        at = segment_of(key.view(np.uint64), segments)
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
        for a, b in zip(cut, [*cut[1:], len(at)]):
            if at[a] != segment:
                if held:
                    yield segment, *(np.concatenate(x) for x in zip(*held))
                segment, held = int(at[a]), []
            held.append((key[a:b], n[a:b]))
    if held:
        yield segment, *(np.concatenate(x) for x in zip(*held))


def pair_logs(pair: np.ndarray, before: np.ndarray, word: np.ndarray, n_tokens: int, n_words: int) -> np.ndarray:
    """log10 probabilities from the levels of a pair and of its first and second word."""
    c_pair = count_of(pair)
    single = (np.minimum(count_of(word), n_tokens) + 1) / (n_tokens + n_words + 1)
    return np.log10((c_pair + PRIOR * single) / (np.maximum(count_of(before), c_pair) + PRIOR))


def score_texts(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", top_share: float = TOP_SHARE, resident: int = RESIDENT) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) per row.

    `base_score` takes exact counts: those of the most frequent words are at hand, those of rarer ones are
    joined. `score` is the log10 probability under the model. Null and empty texts are one end. Rows that
    repeat an id and its text get the same result each; a null id stays. Other columns are not looked at.
    """
    spark = df.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    least = max(1, math.ceil(top_share * model.n_tokens))
    top = model.vocabulary.where(F.col("n") >= least).toArrow()
    order = np.argsort(top.column("hash").to_numpy().view(np.uint64))
    known = spark.sparkContext.broadcast(
        (top.column("hash").to_numpy().view(np.uint64)[order], np.log10(top.column("n").to_numpy()[order] + 1.0).astype(np.float64))
    )  # 1 / top_share words at most
    at_hand = model.filter_bytes <= resident
    bits = spark.sparkContext.broadcast(Filter({r["segment"]: bytes(r["bits"]) for r in model.segments.toLocalIterator()}, model.n_segments) if at_hand else None)
    n_segments, n_tokens, n_words = model.n_segments, model.n_tokens, model.n_words
    names = ["id", "tie", "n_tokens", "n_known", "logs", "score", "hash", "times"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per text, with hash null, and one for each rarer word of it."""
        words, logs = known.value
        probe = bits.value
        for batch in batches:
            data, off = utf8(batch.column(2))
            parts = []
            for a, b in chunks(off, 1 << 19):
                token, before, row = tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])
                parts.append((token, before, row + a))
            if not parts:
                continue
            token, before, row = (np.concatenate(x) for x in zip(*parts))
            count = batch.num_rows
            own, place = np.unique(token, return_inverse=True)
            at = np.minimum(np.searchsorted(words, own), max(len(words) - 1, 0))
            found = words[at] == own if len(words) else np.zeros(len(own), bool)
            gained = np.where(found, logs[at], 0.0) if len(words) else np.zeros(len(own))
            total = lambda x: np.bincount(row, x, minlength=count)
            score = np.zeros(count)
            if probe is not None:
                levels = np.append(probe.levels(word_key(own)), probe.levels(word_key(np.array([_BEGIN]))))
                first = np.concatenate([[True], row[1:] != row[:-1]])
                prior = np.where(first, len(own), np.concatenate([[0], place[:-1]]))
                keys = pair_key(before, token)
                score = total(pair_logs(probe.levels(keys), levels[prior], levels[place], n_tokens, n_words))
            size = total(None)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(size.astype(np.int64)), pa.array(total(found[place].astype(float)).astype(np.int64)), pa.array(total(gained[place])), pa.array(score), pa.nulls(count, pa.int64()), pa.nulls(count, pa.int64())],
                names,
            )
            rare = np.flatnonzero(~found[place])
            pair, times = np.unique(row[rare] * len(own) + place[rare], return_counts=True)
            where = pa.array(pair // len(own))
            m = len(pair)
            yield pa.record_batch(
                [batch.column(0).take(where), batch.column(1).take(where), *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())), signed(own[pair % len(own)]), pa.array(times)],
                names,
            )

    mapped = settle(rows.mapInArrow(build, f"id {kind}, tie long, n_tokens long, n_known long, logs double, score double, hash long, times long"), "scored")
    texts = mapped.where("hash is null")
    # rows that repeat a text repeat its rarer words: each (id, tie, hash) counts once
    rare = mapped.where("hash is not null").select("id", "tie", "hash", "times").distinct().join(model.vocabulary.where(F.col("n") < least), "hash")
    more = rare.groupBy("id", "tie").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    joined = texts.alias("t").join(more.alias("m"), _same("t", "m"), "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n_tokens + n_words + 1))
    out = joined.select("t.id", "t.tie", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), base.alias("base_score"), "score")
    if not at_hand:
        parts = []
        for turn in range(TURNS):  # what was shuffled before goes first
            release(spark)
            parts.append(settle(_routed_scores(rows.where(F.pmod("tie", F.lit(TURNS)) == turn), model, kind), "routed"))
        release(spark)
        routed = functools.reduce(DataFrame.unionAll, parts)
        out = out.drop("score").alias("t").join(routed.alias("r"), _same("t", "r"), "left").select("t.id", "n_tokens", "n_known", "base_score", "r.score")
    return out.drop("tie").withColumnRenamed("id", id_col)


def _same(a: str, b: str):
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.tie") == F.col(f"{b}.tie"))


_ROUTED = ["batch", "segment", "part", "what", "ids", "ties", "sizes", "data"]
#: What a row of routed probes is: the bits of a segment, the tokens of some texts, or probes and their levels.
_BITS, _TEXTS, _PROBES = -2, -1, 0
#: Probes in a row at most.
_PART = 4096


def _probes(own: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, pair, before) of texts whose tokens are `own[place]` and begin at `first`: the keys of their different pairs, then of their words and the beginning; and of each token the pair and the word before it."""
    n = len(own) + 1
    before = np.empty(len(place), np.int64)
    before[1:] = place[:-1]
    before[first] = n - 1
    pairs, pair = np.unique(before * n + place, return_inverse=True)
    words = np.append(own, _BEGIN)
    return np.append(pair_key(words[pairs // n], words[pairs % n]), word_key(words)), pair, before


def _routed_scores(rows: DataFrame, model: LanguageModel, kind: str) -> DataFrame:
    """(id, tie, score) where the filter is too large for a worker: probes are dealt to the segments, and their levels come back.

    Some texts ask together, once for each of their different pairs and words: eight bytes, and one comes back. Their
    tokens go with them as numbers of their words.
    """
    n_segments, n_tokens, n_words = model.n_segments, model.n_tokens, model.n_words

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, off = utf8(batch.column(2))
            for a, b in chunks(off, 1 << 22):
                token, _, row = tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])
                own, place = np.unique(token, return_inverse=True)
                sizes = np.bincount(row, minlength=b - a)
                key, _, _ = _probes(own, place, np.cumsum(sizes) - sizes)
                segment = segment_of(key, n_segments)
                order = np.argsort(segment, kind="stable")
                key, segment = key[order], segment[order]
                cut = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
                ends = np.append(cut[1:], len(key))
                parts = [(int(segment[u]), p, key[v : min(v + _PART, w)].tobytes()) for u, w in zip(cut.tolist(), ends.tolist()) for p, v in enumerate(range(u, w, _PART))]
                said = own.tobytes() + zlib.compress(place.astype(np.uint32 if len(own) >> 16 else np.uint16).tobytes(), 1)
                parts.append((number % n_segments, len(own), said))
                n = len(parts)
                what = np.full(n, _PROBES, np.int32)
                what[-1] = _TEXTS
                held = np.append(np.zeros(n, np.int32), np.int32(b - a))
                lists = [pa.ListArray.from_arrays(pa.array(held), v) for v in (batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes.astype(np.int32)))]
                ints = [pa.array([part[c] for part in parts], pa.int32()) for c in (0, 1)]
                out = pa.record_batch([pa.array(np.full(n, number)), *ints, pa.array(what), *lists, pa.array([part[2] for part in parts], pa.binary())], _ROUTED)
                for at in range(0, n, 1000):
                    yield out.slice(at, 1000)
                number += 1

    schema = f"batch long, segment int, part int, what int, ids array<{kind}>, ties array<long>, sizes array<int>, data binary"
    asked = rows.mapInArrow(ask, schema)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ids", f"array<{kind}>"), ("ties", "array<long>"), ("sizes", "array<int>"))]
    bits = model.segments.select(F.lit(0).cast("long").alias("batch"), "segment", F.lit(0).alias("part"), F.lit(_BITS).alias("what"), *none, F.col("bits").alias("data"))
    both = asked.unionByName(bits).repartition("segment").sortWithinPartitions("segment", "what")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, probe = None, Filter({}, n_segments)
        for batch in batches:
            at, what, out = np.asarray(batch.column(1)), np.asarray(batch.column(3)), batch.column(7).to_pylist()
            cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (what[1:] != what[:-1]))).tolist() if len(at) else []
            for a, b in zip(cut, [*cut[1:], len(at)]):
                if at[a] != segment:
                    segment = int(at[a])
                    probe = Filter({segment: out[a]} if what[a] == _BITS else {}, n_segments)
                if what[a] == _PROBES:
                    ends = np.cumsum([len(v) // 8 for v in out[a:b]]).tolist()
                    levels = probe.levels(np.frombuffer(b"".join(out[a:b]), np.uint64)).astype(np.uint8).tobytes()
                    out[a:b] = [levels[u:v] for u, v in zip([0, *ends], ends)]
            told = pa.record_batch([*batch.columns[:7], pa.array(out, pa.binary())], _ROUTED)
            yield told.filter(pa.array(what != _BITS))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, levels = None, []

        def scored() -> pa.RecordBatch:
            ids, ties, sizes, n_own, data = held
            own = np.frombuffer(data[: 8 * n_own], np.uint64)
            place = np.frombuffer(zlib.decompress(data[8 * n_own :]), np.uint32 if n_own >> 16 else np.uint16).astype(np.int64)
            key, pair, before = _probes(own, place, np.cumsum(sizes) - sizes)
            level = np.empty(len(key), np.int64)
            level[np.argsort(segment_of(key, n_segments), kind="stable")] = np.frombuffer(b"".join(levels), np.uint8)
            of_pair, of_word = level[: -n_own - 1], level[-n_own - 1 :]
            logs = pair_logs(of_pair[pair], of_word[before], of_word[place], n_tokens, n_words)
            total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs, minlength=len(sizes))
            return pa.record_batch([ids, ties, pa.array(total)], ["id", "tie", "score"])

        for batch in batches:
            for x, what in enumerate(np.asarray(batch.column(3)).tolist()):
                data = batch.column(7)[x].as_py()
                if what == _TEXTS:
                    if held is not None:
                        yield scored()
                    levels = []
                    held = (batch.column(4)[x].values, batch.column(5)[x].values, batch.column(6)[x].values.to_numpy(), batch.column(2)[x].as_py(), data)
                else:
                    levels.append(data)
        if held is not None:
            yield scored()

    told = both.mapInArrow(answer, schema).repartition("batch").sortWithinPartitions("batch", "what", "segment", "part")
    # rows that repeat an id and its text have the same score
    return told.mapInArrow(score, f"id {kind}, tie long, score double").groupBy("id", "tie").agg(F.max("score").alias("score"))
