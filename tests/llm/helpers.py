"""Plain Python versions of what the operators compute, and small tables with every odd case."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def docs(spark, rows, parts=3):
    """Documents with all columns; rows are (doc_id, text)."""
    full = [(i, t, "en", None, None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)


def clashing(df):
    """The table with columns named like those that operators make inside."""
    names = ["id", "tie", "n", "spans", "key", "row", "found", "matches", "score", "class", "carried", "kept", "label"]
    for name in names:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df
