"""Mixing sources to target weights: capped water-filling, then whole and fractional epochs.

DataFrame functions only. Sources are a small table of their own; documents never meet in
one task, however many a source has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwarden.llm.common import free_names, stored

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
EPOCHS = 2.0
SEED = "mix"


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """source_key, source_size, n_docs and place (from 0, by code point, null last). Sources
    are cut into ranges of order; a place is the number of sources in earlier ranges and
    earlier in the own one."""
    sources = sizes.groupBy("source_key").agg(
        F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("n_docs")
    )
    ranges = sources.repartitionByRange("source_key").withColumn("range", F.spark_partition_id())
    ranges = stored(ranges, "sources")
    before = ranges.groupBy("range").count()
    before = before.select(
        "range",
        (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"),
    )
    inside = F.row_number().over(Window.partitionBy("range").orderBy("source_key"))
    return ranges.join(before, "range").select(
        "source_key", "source_size", "n_docs", (F.col("before") + inside - 1).alias("place")
    )


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS) -> DataFrame:
    """Adds target. The budget is ``budget`` times all sizes, shared by weight; sources that
    would need more than ``epochs`` of themselves are held there, and what is left is shared
    anew among the others until none is above. Each round is one aggregate over the sources;
    a level only rises, so a held source stays held."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = stored(
        sources.withColumn("weight", weight.cast("double")).withColumn("most", F.lit(epochs) * F.col("source_size")),
        "weights",
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    left, share, held = budget * total, None, -1
    above = F.lit(False)
    while True:
        row = weighed.agg(
            F.count(F.when(above, 1)).alias("held"),
            F.sum(F.when(above, F.col("most")).otherwise(0.0)).alias("most"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if row["held"] == held:
            break
        held, share = row["held"], (left - (row["most"] or 0.0), row["weight"])
        if not row["weight"]:
            break
        above = F.col("weight") * F.lit(share[0]) > F.col("most") * F.lit(share[1])
    if not share or not share[1]:
        return weighed.withColumn("target", F.col("most"))
    fair = F.col("weight") * F.lit(share[0]) / F.lit(share[1])
    return weighed.withColumn("target", F.when(above, F.col("most")).otherwise(fair))


def _running(cells: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of earlier rows inside the keys."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def source_key(source_col: str) -> F.Column:
    """The source, null as a key of its own behind all others."""
    column = F.col(source_col)
    return F.when(column.isNull(), F.lit("\U0010ffff\U0010ffff")).otherwise(F.concat(F.lit("0"), column))


def decide(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights=WEIGHTS,
    budget: float = BUDGET,
    epochs: float = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """Returns id, source_key, size, times, source_size, target, copies: one row for each
    document, or for each set of ``times`` repeated rows that agree in id, source and size.

    A size is the number of words (null text: 0). Sources are in order of code point, null
    last, and have the weights in turn. Every row is taken for each whole epoch of its
    source's target; of the fraction, rows are taken in seeded order while the middle of the
    row lies within it, so a source misses its target by at most half a document (repeated
    rows are taken alike and count together). The order is the md5 of seed and id, then id
    and size. A source without words has target 0. No rows give none.

    Running sums are in three levels, with about the cube root of the source's rows in a
    group, so a source with a third of all rows is many groups.
    """
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), name)), 1, 15), 16, 10).cast("long")
    sizes = df.select(
        F.col(id_col).alias("id"), source_key(source_col).alias("source_key"), word_count(text_col).alias("size")
    )
    sizes = sizes.groupBy("id", "source_key", "size").agg(F.count("*").alias("times"))
    sizes = stored(sizes.withColumn("draw", draw), "sizes")
    aims = stored(targets(ranked_sources(sizes), weights, budget, epochs), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = aims.select(
        "source_key", "source_size", "target",
        F.floor(rate).alias("whole"),
        (F.col("target") - F.floor(rate) * F.col("source_size")).alias("quota"),
        F.ceil(F.pow(F.col("n_docs").cast("double"), 1 / 3)).cast("long").alias("fan"),
    )
    fine = F.shiftright(F.shiftright("draw", 30) * F.col("fan") * F.col("fan"), 30)  # draw has 60 bits
    placed = sizes.join(aims, "source_key").withColumn("cell", fine)
    placed = placed.withColumn("block", F.floor(F.col("cell") / F.col("fan")))
    cells = placed.groupBy("source_key", "block", "cell").agg(F.sum(F.col("size") * F.col("times")).alias("cell_size"))
    blocks = cells.groupBy("source_key", "block").agg(F.sum("cell_size").alias("block_size"))
    blocks = _running(blocks, ["source_key"], "block", "block_size", "before_block")
    cells = _running(cells, ["source_key", "block"], "cell", "cell_size", "before_cell")
    cells = cells.join(blocks.drop("block_size"), ["source_key", "block"])
    starts = cells.select("source_key", "cell", (F.col("before_block") + F.col("before_cell")).alias("start"))
    inside = (
        Window.partitionBy("source_key", "cell").orderBy("draw", "id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    words = F.col("size") * F.col("times")
    before = F.col("start") + F.coalesce(F.sum(words).over(inside), F.lit(0))
    extra = (2 * before + words <= 2 * F.col("quota")) & (F.col("quota") > 0)
    rows = placed.join(starts, ["source_key", "cell"]).withColumn(
        "copies", F.col("whole") + extra.cast("long")
    )
    return rows.select("id", "source_key", "size", "times", "source_size", "target", "copies")


def report(decided: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, size, source_size, target and taken (words taken, repeats counted), one row
    for every row of the mixed table."""
    return decided.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("row"),
    ).drop("row")


def mixed(df: DataFrame, decided: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of the mix with all their columns, each as often as it is taken."""
    names = free_names(df, "id__", "source__", "size__", "copies__", "row__")
    own, source, size, copies, row = names
    marks = decided.where("copies > 0").select(
        F.col("id").alias(own), F.col("source_key").alias(source), F.col("size").alias(size), F.col("copies").alias(copies)
    )
    same = (
        F.col(id_col).eqNullSafe(F.col(own))
        & (source_key(source_col) == F.col(source))
        & (word_count(text_col) == F.col(size))
    )
    taken = df.join(marks, same).withColumn(row, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return taken.select(*df.columns)
