"""Chat formatting of reply trees.

Messages name the message they answer. Self-joins that double their reach list the messages
on every path from a leaf to its root; the branches of a root are ranked by the sum of their
messages' scores, and each chosen path is formatted as one conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwarden.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``messages``: node (unique), parent, score. Returns leaf, node, place (from the root,
    from 0) for the ``branches`` best paths of every root: largest sum of scores (null: 0),
    ties to the smaller leaf. A parent that is no message makes a root. Messages that answer
    each other in a circle have no root and are left out, as are those that lead into one and
    rows without a node.

    The k-th self-join adds the ancestors 2^k to 2^(k+1) - 1 steps up, so the number of joins
    is the logarithm of the longest path. Only keys travel; a much answered message is many
    rows of a join.
    """
    nodes = stored(
        messages.where("node IS NOT NULL").select("node", "parent", F.coalesce("score", F.lit(0)).alias("score")), "nodes"
    )
    known = nodes.select(F.col("node").alias("parent"))
    up = stored(nodes.select("node", "parent").join(known, "parent").select("node", F.col("parent").alias("above")), "up")
    leaves = nodes.select("node").join(up.select(F.col("above").alias("node")).distinct(), "node", "left_anti")
    levels, step, most = [], 1, nodes.count()
    while step <= most and not up.isEmpty():
        levels.append((step, up))
        twice = up.select("node", F.col("above").alias("middle")).join(
            up.select(F.col("node").alias("middle"), "above"), "middle"
        )
        up, step = stored(twice.select("node", "above"), "up"), 2 * step
    if step > most:  # more steps up than there are messages: into a circle
        leaves = leaves.join(up.select("node"), "node", "left_anti")
    listed = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("far"))
    for step, up in levels:
        further = listed.join(up, "node").select("leaf", F.col("above").alias("node"), (F.col("far") + step).alias("far"))
        listed = stored(listed.union(further), "listed")
    scored = listed.join(nodes.select("node", "score"), "node").groupBy("leaf").agg(
        F.sum("score").alias("score"),
        F.max(F.struct("far", "node")).alias("top"),
    )
    best = Window.partitionBy("top.node").orderBy(F.desc("score"), "leaf")
    chosen = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    chosen = chosen.select("leaf", F.col("top.far").alias("depth"))
    return listed.join(chosen, "leaf").select("leaf", "node", (F.col("depth") - F.col("far")).alias("place"))


def escape(text: str) -> str:
    """No escaped text holds a control string; ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def formatted(turns: list[dict]) -> tuple[str, list[dict]]:
    """The conversation and the spans (begin, end) that are learned."""
    parts, spans, at = [], [], 0
    for turn in turns:
        role = escape(turn["role"] or "").replace("\n", "\\\r")
        head, text = f"{START}{role}\n", escape(turn["text"] or "")
        if turn["role"] == LEARNED:
            spans.append({"begin": at + len(head), "end": at + len(head) + len(text)})
        parts.append(f"{head}{text}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parsed(conversation: str) -> list[tuple[str, str]]:
    """Role and text of every turn. No role holds a line end: it is written as \\ and CR, and
    a CR after a backslash stands for nothing else, as a backslash of the role is doubled."""
    turns = []
    for part in conversation.split(f"{END}\n")[:-1]:
        role, _, text = part[len(START) :].partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "\r" else m[1], role, flags=re.DOTALL)
        turns.append((role, unescape(text)))
    return turns


def write(turns: DataFrame) -> DataFrame:
    """``turns``: conv_id, turns (array of role, text). Returns conv_id, formatted, spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [formatted(x) for x in part.column(1).to_pylist()]
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _ in found]), pa.array([x for _, x in found], kind)],
                    ["conv_id", "formatted", "spans"],
                )

    schema = "conv_id long, formatted string, spans array<struct<begin: long, end: long>>"
    return turns.select("conv_id", "turns").mapInArrow(work, schema)


def read(output: DataFrame) -> DataFrame:
    """Returns conv_id, turns (array of role, text), learned (all text under the spans,
    unescaped) and formatted_chars."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, spans = part.column(1).to_pylist(), part.column(2).to_pylist()
                turns = [[{"role": r, "text": t} for r, t in parsed(x)] for x in texts]
                learned = [
                    "".join(unescape(x[s["begin"] : s["end"]]) for s in own)
                    for x, own in zip(texts, spans, strict=True)
                ]
                kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(turns, kind), pa.array(learned, pa.string()),
                     pa.array([len(x) for x in texts], pa.int64())],
                    ["conv_id", "turns", "learned", "formatted_chars"],
                )

    schema = "conv_id long, turns array<struct<role: string, text: string>>, learned string, formatted_chars long"
    return output.select("conv_id", "formatted", "spans").mapInArrow(work, schema)


def from_turns(conversations: DataFrame) -> DataFrame:
    """Conversations as reply chains: every turn answers the one before it. Rows are in order
    of turn (null first), then role and text; repeated rows are turns of their own, rows
    without a conversation are one conversation. A conversation is one row in the end, so it
    must fit in one."""
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    placed = conversations.select("conv_id", "turn", "role", "text").withColumn("at", order)
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    key = lambda at: F.concat_ws(":", name, at.cast("string"))
    return placed.select(
        "conv_id", "role", "text", key(F.col("at")).alias("node"),
        F.when(F.col("at") > 1, key(F.col("at") - 1)).alias("parent"), F.lit(0.0).alias("score"),
    )


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``messages``: conv_id, node, parent, score, role, text. One row for each chosen path:
    conv_id, turns."""
    chosen = paths(messages.select("node", "parent", "score"), branches)
    texts = messages.select("node", "conv_id", "role", "text")
    turn = F.struct("place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = chosen.join(texts, "node").groupBy("conv_id", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def summary(back: DataFrame) -> DataFrame:
    """Digests of what was read back."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
