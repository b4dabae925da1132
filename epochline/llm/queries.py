"""The queries of the corpus operators over the test tables, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochline.llm import alignment, bpe, chains, decontaminate, jaccard, langid, lm, merkle, packing, quality, repeats, runs, sql, toolcalls
from epochline.operators.ordered import Fill, Lag, with_ordered
from epochline.session import settle

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def bpe_digests(docs: DataFrame) -> DataFrame:
    both = bpe.round_trip(docs, public_tokenizers.path(WORD_BPE))
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op1_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that earlier documents have too, exactly or nearly."""
    return chains.repeated_passages(read(spark, sf_dir, "documents"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document, learned from six sevenths of them."""
    docs = read(spark, sf_dir, "documents")
    model = lm.fit_model(docs.where(fold(7) != 2))
    found = lm.score_texts(docs, model)
    return found.select(
        "doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def test_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.question_and_answer(read(spark, sf_dir, "benchmark"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that documents hold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_matches(docs, test_items(spark, sf_dir))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = read(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(fold(3) != 1))
    found = langid.label_languages(docs, model)
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), F.col("lang").alias("lang_pred"), "score", F.size("spans").alias("n_spans"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 4-word shingles agree to 85 in 100."""
    found = jaccard.similar_classes(read(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


#: What a call made of a turn has to look like, by what the turn calls for.
_TURN = {
    "conversation": {"type": "integer", "minimum": 0},
    "turn": {"type": "integer", "minimum": 0},
    "prompt": {"type": "string", "minLength": 1, "maxLength": 100_000},
    "after": {"type": "string"},
    "under": {"type": "string"},
}
_CALL = {"type": "object", "required": ["conversation", "turn", "prompt"], "additionalProperties": False, "properties": _TURN}
CALL_SCHEMAS = {"reply": _CALL, "instruct": {**_CALL, "properties": {k: v for k, v in _TURN.items() if k != "under"}}}


def op6_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool calls, a row per turn.

    A user's turn calls for a reply and refers to the result of the call before it (`after`), and to the instruction it stands under (`under`);
    a system turn is a call that instructs and has no result; an assistant's turn, or one of any other role, is the result of the user's
    turn before it. Results without a call, and more than one result of a call, are rows of their own.
    """
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asks, instructs = F.col("role").eqNullSafe("user"), F.col("role").eqNullSafe("system")
    turns = turns.withColumns({"asking": F.when(asks, F.col("turn")), "instructing": F.when(instructs, F.col("turn"))})
    seen = {"asked": Fill("asking", direction="forward"), "told": Fill("instructing", direction="forward")}
    ordered = settle(with_ordered(settle(turns, "turns"), "turn", seen, ["conv_id"], ["role", "text"]), "turns")
    asked = with_ordered(ordered, "turn", {"earlier": Lag("asked")}, ["conv_id"], ["role", "text"])
    named = lambda c: F.concat(F.lit("turn-"), c.cast("string"))
    refer = lambda c: F.when(c.isNotNull(), F.create_map(F.lit("$result"), named(c)))
    arguments = F.struct(F.col("conv_id").alias("conversation"), "turn", F.col("text").alias("prompt"), refer(F.col("earlier")).alias("after"), F.when(asks, named(F.col("told"))).alias("under"))
    calls = asked.where(asks | instructs).select(
        "conv_id", named(F.col("turn")).alias("call_id"), F.col("turn").alias("seq"), F.when(asks, "reply").otherwise("instruct").alias("name"), F.to_json(arguments).alias("arguments")
    )
    results = asked.where(~(asks | instructs)).select("conv_id", named(F.col("asked")).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return toolcalls.link_calls(calls, results, CALL_SCHEMAS)


def quality_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with all their columns, and `predicted`."""
    labels = read(spark, sf_dir, "labels").where(fold(5) != 0)
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels), keep=tuple(docs.columns))
    return scored.select("kept.*", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by rules learned from four fifths of the labels."""
    docs = read(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.fit_quality(docs, read(spark, sf_dir, "labels").where(fold(5) != 0)))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of a half edited one."""
    found = merkle.compare_edits(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "changed", "changed_edited"
    )


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that start earlier."""
    cut = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe_digests(read(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents the words from some place on become a repeated stretch."""
    docs = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g, n = F.floor(F.col("h") / 10), F.size("w").cast("long")
    edited = docs.where("h % 10 = 0").withColumn("w", words).withColumn("a", F.when(n > 0, F.pmod(g, n)))
    edited = edited.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.pmod(g, F.lit(8)))))
    places = F.sequence(F.lit(0).cast("long"), n - 1)
    moved = F.transform(places, lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))))
    edited = edited.withColumn("text", F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text")))
    return docs.where("h % 10 <> 0 or h is null").unionByName(edited.select("doc_id", "text", "h")).select("doc_id", "text")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which get one."""
    found = runs.periodic_runs(with_planted_runs(read(spark, sf_dir, "documents")))
    order = lambda x, y: F.when(x.length != y.length, y.length - x.length).when(x.start != y.start, x.start - y.start).otherwise(x.period - y.period)
    best = F.get(F.array_sort("runs", lambda x, y: order(x, y).cast("int")), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), capacity=2048, end_id=0)
    return packed.withColumn("length", F.col("length").cast("long"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document."""
    docs = read(spark, sf_dir, "documents")
    return alignment.align_documents(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


_ALL = (
    op1_chains, op2_lm, op3_decontaminate, op4_langid, op5_jaccard, op6_toolcalls, op7_quality, op8_merkle, op9_repeats, op10_bpe, op11_runs, op12_packing, op13_alignment,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op5_jaccard": sql.OP5, "op9_repeats": sql.OP9, "op11_runs": sql.OP11}
