"""Every row with the text of the row that follows it in the order of an id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a range, and ranges whose bounds approximate quantiles are asked for. Beyond that many, ranges grow: there are
#: then tasks enough, and a range is streamed, so its size is no matter of memory.
RANGE, RANGES = 2_000, 20_000


def map_with_next(df: DataFrame, id_col: str, text_col: str, visit: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Calls `visit` with (id, text, is_extra) in descending order of a numeric id; a null id comes last, ties go by a hash of the text.

    The rows come range by range, as ("range", n) markers and rows. The first row of the next range follows
    the rows of a range as an extra one; the first row of all follows the last. So every row but an extra one
    has the row after it next in line, and no task needs more than a row at a time.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select(F.col("id").cast("double").alias("x"))
    wanted = max(1, min(RANGES, ids.count() // RANGE))
    splits = np.unique(ids.approxQuantile("x", [k / wanted for k in range(1, wanted)], 0.2 / wanted) if wanted > 1 else []).tolist()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).cast(pa.float64()).to_numpy(zero_copy_only=False)
            at = np.where(np.isnan(x), -1, np.searchsorted(splits, np.nan_to_num(x, nan=0.0), "right"))
            yield pa.record_batch([pa.array(at.astype(np.int32)), *batch.columns], ["range", *batch.schema.names])

    kind = rows.schema["id"].dataType.simpleString()
    firsts = (
        rows.select("id").mapInArrow(place, f"range int, id {kind}").groupBy("range").agg(F.max("id").alias("id")).orderBy(F.desc("range")).collect()
    )  # one row per range
    order = [r["range"] for r in firsts]
    before = {r["id"]: order[k - 1] for k, r in enumerate(firsts)}  # the range that the first row of a range follows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in place(batches):
            yield batch.append_column("extra", pa.array(np.zeros(batch.num_rows, np.int32)))
            copies = [(i, before[x]) for i, x in enumerate(batch.column(1).to_pylist()) if x in before]
            if copies:
                taken = batch.take(pa.array([i for i, _ in copies]))
                ranges = pa.array([r for _, r in copies], pa.int32())
                yield pa.record_batch([ranges, *taken.columns[1:], pa.array(np.ones(len(copies), np.int32))], [*batch.schema.names, "extra"])

    dealt = rows.mapInArrow(deal, f"range int, id {kind}, text string, extra int")
    lined = dealt.withColumn("tie", F.xxhash64("text")).repartition("range").sortWithinPartitions("range", "extra", F.desc_nulls_last("id"), "tie")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in range(4)))

        return visit(stream())

    return lined.select("range", "id", "text", "extra").mapInArrow(walk, schema)
