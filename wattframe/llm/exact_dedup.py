"""Exact duplicates by radix partitioning, most significant bytes first.

A group of documents is split by its next bytes until it holds one document or
its texts have ended. The first digit is short, since it parts nearly all
texts; later digits grow, so that even very long copies take few rounds. Two
texts are equal when they took the same way to the end; no digest decides.

A round is one aggregation (digit and group to number of rows and largest id;
copies shrink before the shuffle) and one join back to the texts still open.
What a round leaves is written to the shared folder, so a lost executor costs
no more than the round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import field, pick, stored, unboxed

#: Bytes of the first digit, and how many times longer each next one is.
FIRST_BYTES, GROWTH = 64, 16


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST_BYTES, growth: int = GROWTH, carry_text: bool = True
) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` (fields ``_0``, ``_1``, ... in the
    order of its columns; see ``common.unboxed``) with ``keep_id`` (largest id
    among the rows of equal text), ``group_size`` and ``kept``. Without
    ``carry_text`` the text is null in the result.

    Null texts count as empty and are equal to empty ones. Null ids count as
    smaller than any other. Of rows that repeat both text and largest id one is
    kept. An empty table gives an empty one; further columns may have any name.
    """
    if first < 1 or growth < 2:
        raise ValueError("first has to be at least 1 and growth at least 2")
    names = docs.columns
    at = names.index(text_col)
    held = docs.toDF(*[f"_{i}" for i in range(len(names))])
    others = [c for i, c in enumerate(held.columns) if i != at]
    left = held.select(
        F.lit(0).cast("long").alias("grp"),
        F.col(f"_{names.index(id_col)}").alias("id"),
        F.col(f"_{at}").alias("text"),
        F.struct(*others).alias("others"),
    )
    done, start, width, rounds = [], 0, first, 0
    while True:
        # A digit that is not full ends its text; a text that ends just with a full
        # one shows an empty digit in the next round.
        digit = F.substring(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), start + 1, width)
        groups = left.groupBy("grp", digit.alias("digit")).agg(F.count("*").alias("n"), F.max("id").alias("keep")).where("n > 1")
        groups = stored(groups.withColumn("next", F.monotonically_increasing_id()), "radix-groups")
        ended = F.col("n").isNull() | (F.length("digit") < width)
        # Merged, not broadcast: groups of copies grow with the table.
        split = left.withColumn("digit", digit).join(groups.hint("merge"), ["grp", "digit"], "left").select(
            ended.alias("ended"),
            F.col("next").alias("grp"),
            "id",
            F.col("text") if carry_text else F.when(~ended, F.col("text")).alias("text"),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"),
            F.coalesce("n", F.lit(1)).cast("long").alias("n"),
            F.lit(rounds).alias("round"),
            F.monotonically_increasing_id().alias("tag"),
            "others",
        )
        split = stored(split, "radix-round")
        done.append(split.where("ended").drop("ended"))
        left = split.where("not ended").select("grp", "id", "text", "others")
        if left.isEmpty():
            break
        start, width, rounds = start + width, width * growth, rounds + 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    row = F.struct(*[F.col("text" if i == at else f"others._{i}").alias(f"_{i}") for i in range(len(names))])
    return _one_of_each(rows.withColumn("row", row))


def _one_of_each(rows: DataFrame) -> DataFrame:
    """``kept``: single rows, and of each group the row with the largest id (the
    first such row where an id repeats)."""
    best = F.col("id").eqNullSafe(F.col("keep"))
    grouped = F.col("grp").isNotNull()
    repeated = (
        rows.where(grouped & best).groupBy("round", "grp").agg(F.count("*").alias("c"), F.min("tag").alias("first")).where("c > 1").drop("c")
    )
    # Usually empty; where not, it has one row per group with a repeated id.
    return rows.join(stored(repeated, "radix-ties"), ["round", "grp"], "left").select(
        "row",
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        (best & (F.col("first").isNull() | (F.col("tag") == F.col("first")))).alias("kept"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    return unboxed(exact_duplicates(docs, id_col, text_col).where("kept"), docs.columns)


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256`` (of the text in UTF-8, null as empty)."""
    named = pick(docs, id=id_col, text=text_col).withColumn("sha", F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256))
    found = exact_duplicates(named, "id", "text", carry_text=False)
    return found.select(
        field(named.columns, "id").alias("doc_id"), "keep_id", "group_size", "kept", field(named.columns, "sha").alias("text_sha256")
    )
