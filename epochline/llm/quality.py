"""Quality classifier: a sparse ensemble of rules over text statistics.

The paths of small trees become conjunctive rules, a lasso logistic regression weighs them and drops most,
and what is left is compiled into a Spark column expression.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochline.llm.arrow_text import Words, chunks, small_batches, utf8
from epochline.session import settle

STATISTICS = (
    "n_chars n_words word_length upper digits marks pipes stops capital_words marked_words distinct_words "
    "same_as_before distinct_lines words_per_line longest_word other_chars"
).split()
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "marks": b"!?*#$%&@<>{}[]\\^~=_+", "pipes": b"|", "stops": b".,;:"}
_MEMBER = {name: np.isin(np.arange(256), list(found)) for name, found in _CLASSES.items()}
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC0:] = True  # the first byte of any longer character
_FIRST = (np.arange(256) & 0xC0) != 0x80


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[first[1:]] - total[first[:-1]]).astype(float)


def _distinct(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=rows).astype(float)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text; shares are 0 where there is nothing to divide by."""
    rows = len(off) - 1
    words = Words(data, off)
    n_words = np.diff(words.first).astype(float)
    chars = _per_text(_FIRST[data], off)
    letters = _per_text(_LETTER[data], off)
    over = lambda a, b: np.divide(a, b, out=np.zeros(rows), where=b > 0)
    solid = np.zeros(rows)
    lengths = (words.end - words.start).astype(float)
    np.add.at(solid, words.row, lengths)
    longest = np.zeros(rows)
    np.maximum.at(longest, words.row, lengths)
    last, head = data[words.end - 1], data[words.start]
    marked = _MEMBER["marks"][last]
    second = data[np.minimum(words.start + 1, max(len(data) - 1, 0))]
    capital = _MEMBER["upper"][head] & _MEMBER["upper"][second]
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    per_word = lambda flags: over(np.bincount(words.row[flags], minlength=rows).astype(float), n_words)
    ends = np.zeros(len(data), bool)
    ends[data == 10] = True
    line = np.cumsum(ends) if len(data) else np.zeros(0, np.int64)
    word_line = line[words.start]
    opens = np.ones(len(words.hash), bool)
    opens[1:] = (word_line[1:] != word_line[:-1]) | (words.row[1:] != words.row[:-1])
    starts = np.flatnonzero(opens)
    if len(starts):
        weight = np.arange(len(words.hash), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(words.hash)))).astype(np.uint64)
        line_hash = np.add.reduceat(words.hash * (np.uint64(2) * weight + np.uint64(1)), starts)
    else:
        line_hash = np.zeros(0, np.uint64)
    lines = np.bincount(words.row[starts], minlength=rows).astype(float)
    found = {
        "n_chars": chars,
        "n_words": n_words,
        "word_length": over(solid, n_words),
        **{name: over(_per_text(_MEMBER[name][data], off), letters if name == "upper" else chars) for name in _CLASSES},
        "capital_words": per_word(capital),
        "marked_words": per_word(marked),
        "distinct_words": over(_distinct(words.hash, words.row, rows), n_words),
        "same_as_before": per_word(again),
        "distinct_lines": over(_distinct(line_hash, words.row[starts], rows), lines),
        "words_per_line": over(n_words, lines),
        "longest_word": longest,
        "other_chars": over(chars - letters, chars),
    }
    return np.column_stack([found[name] for name in STATISTICS]) if rows else np.zeros((0, len(STATISTICS)))


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *STATISTICS) per row, and a struct `kept` of the columns to keep; null texts count as empty ones."""
    small_batches(df.sparkSession)
    kept = [F.struct(*keep).alias("kept")] if keep else []
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *kept)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            parts = [statistics(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in chunks(off, 1 << 20)]
            values = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            columns = [pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(STATISTICS))]
            yield pa.record_batch([batch.column(0), *columns, *batch.columns[2:]], ["id", *STATISTICS, *batch.schema.names[2:]])

    kinds = [f"id {rows.schema['id'].dataType.simpleString()}", *(f"{s} double" for s in STATISTICS)]
    kinds += [f"kept {rows.schema['kept'].dataType.simpleString()}"] if keep else []
    return rows.mapInArrow(build, ", ".join(kinds)).withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Rule:
    """All of the conditions (statistic, is_over, threshold) hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, over, threshold in self.conditions:
            out = out & (F.col(name) > threshold if over else F.col(name) <= threshold)
        return out


@dataclass(frozen=True)
class RuleModel:
    bias: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 as an expression over STATISTICS."""
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def to_json(self) -> str:
        return json.dumps({"bias": self.bias, "rules": [{"all": rule.conditions, "weight": w} for rule, w in self.weights]})


def paths(tree: str) -> list[Rule]:
    """Every path of a printed tree, from the root to each inner node and leaf, as a rule."""
    held: list[tuple[int, tuple[str, bool, float]]] = []
    found = []
    for text in tree.splitlines():
        step = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", text)
        if not step:
            continue
        depth = len(step[1])
        held = [h for h in held if h[0] < depth] + [(depth, (STATISTICS[int(step[2])], step[3] == ">", float(step[4])))]
        bounds: dict[tuple[str, bool], float] = {}
        for _, (name, over, threshold) in held:  # the narrowest bound of a statistic is enough
            key = (name, over)
            bounds[key] = threshold if key not in bounds else (max if over else min)(bounds[key], threshold)
        found.append(Rule(tuple((name, over, t) for (name, over), t in sorted(bounds.items()))))
    return found


def fit_rules(labelled: DataFrame, label: str = "label", trees: int = 24, depth: int = 3, penalty: float = 0.001, seed: int = 7) -> RuleModel:
    """Rules and weights from rows of STATISTICS and a 0/1 label. Without both labels the model is the smoothed share of label 1."""
    counts = {int(r[label]): r["count"] for r in labelled.groupBy(label).count().collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    prior = RuleModel(math.log((ones + 1) / (zeros + 1)), ())
    if not ones or not zeros:
        return prior
    rows = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(labelled.withColumn("target", F.col(label).cast("double")))
    forest = RandomForestClassifier(
        labelCol="target", numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=5
    ).fit(rows)
    rules = list(dict.fromkeys(rule for tree in forest.trees for rule in paths(tree.toDebugString)))
    if not rules:
        return prior
    fired = labelled.select(
        F.col(label).cast("double").alias("target"), *(rule.column().cast("double").alias(f"r{i}") for i, rule in enumerate(rules))
    )
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(fired)
    lasso = LogisticRegression(
        featuresCol="rules", labelCol="target", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=100
    ).fit(fired)
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), tuple((rules[i], float(weights[i])) for i in np.flatnonzero(np.abs(weights) > 1e-9)))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", sample: int = 20_000
) -> RuleModel:
    """A model from about `sample` labelled rows at most, chosen by a hash of the id. Rows without id or label are left out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    share = min(1.0, sample / max(1, known.count()))
    bucket = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    chosen = known.where(bucket < math.ceil(share * 1_000_000)).limit(2 * sample)  # the limit only proves the size
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return fit_rules(settle(with_statistics(texts, "id", "text", ("label",)).select("*", "kept.label").drop("kept"), "labelled").coalesce(8))


def score_quality(
    df: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, score, *STATISTICS) per row, and a struct `kept` of the columns to keep.

    Null and empty texts are scored by the rules that no statistic contradicts; repeated rows stay.
    """
    kept = ["kept"] if keep else []
    return with_statistics(df, id_col, text_col, keep).select(id_col, model.score().alias("score"), *STATISTICS, *kept)
