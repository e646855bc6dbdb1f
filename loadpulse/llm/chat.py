"""Chat formatting: reply trees to training conversations, with DataFrame functions only.

Messages point to the message they answer.  Self-joins with ever longer jumps list
every path from a leaf up to its root, in as many rounds as the logarithm of the
longest path.  Branches are ranked by the mean score of their messages, and each
chosen path becomes one text with turn marks, escaped contents and a loss mask.

Edge cases: a null role or text is an empty one, a null score is 0; a parent that is
not there makes a root; repeated or equal turns are all kept, ordered by turn, role
and text; a null conversation id is a conversation of its own; messages in a circle
of parents have no root and are on no path; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


# --- template ------------------------------------------------------------------

def escaped(text: Column) -> Column:
    """Text in which no control string can occur: every ``<|`` is broken up."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def formatted(turns: Column) -> Column:
    """One text from an array of structs with ``role`` and ``text``."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(CLOSE))), "")


def loss_mask(turns: Column) -> Column:
    """Where the learned texts are in the formatted text: spans of code points."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        begin = state["at"] + len(OPEN) + 1 + F.length(F.url_encode(t["role"]))
        end = begin + F.length(escaped(t["text"]))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == LEARNED_ROLE, F.concat(state["spans"], span)).otherwise(
            state["spans"])
        return F.struct((end + len(CLOSE)).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add)["spans"]


def parsed_turns(text: Column) -> Column:
    """The turns of a formatted text: array of structs with ``role`` and ``text``."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        line = F.substring_index(piece, "\n", 1)
        rest = piece.substr(F.length(line) + 2, F.length(piece))
        role = line.substr(F.lit(len(OPEN) + 1), F.length(line))
        return F.struct(F.url_decode(role).alias("role"), unescaped(rest).alias("text"))

    return F.transform(pieces, turn)


def masked_text(text: Column, spans: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(text.substr(
        (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


# --- trees ---------------------------------------------------------------------

def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """``leaf_id, message_id, above`` for every message on the path of every leaf.

    ``above`` counts the steps from the leaf.  Round k joins the paths found so far
    with jumps of 2^k answers, then the jumps with themselves; it ends when no jump
    is that long.  Every round is stored.
    """
    links = messages.select("message_id", "parent_id").dropDuplicates(["message_id"])
    parents = links.select(F.col("message_id").alias("up"))
    jumps = links.join(parents, F.col("parent_id") == F.col("up"), "left_semi").select(
        "message_id", F.col("parent_id").alias("ancestor"))
    jumps, jumps_at = common.stored(jumps, "jumps")
    answered = jumps.select(F.col("ancestor").alias("message_id")).distinct()
    leaves = links.join(answered, "message_id", "left_anti")
    paths = leaves.select(F.col("message_id").alias("leaf_id"), "message_id",
                          F.lit(0).cast("bigint").alias("above"))
    limit, reach, paths_at = links.count(), 1, None
    while reach <= limit and not jumps.isEmpty():
        longer = paths.join(jumps, "message_id").select(
            "leaf_id", F.col("ancestor").alias("message_id"), (F.col("above") + reach).alias("above"))
        paths, new_at = common.stored(paths.unionByName(longer), "paths")
        again = jumps.select(F.col("message_id").alias("ancestor"), F.col("ancestor").alias("further"))
        doubled, doubled_at = common.stored(jumps.join(again, "ancestor").select(
            "message_id", F.col("further").alias("ancestor")), "jumps")
        common.discard(messages.sparkSession, jumps_at, *([paths_at] if paths_at else []))
        jumps, jumps_at, paths_at, reach = doubled, doubled_at, new_at, reach * 2
    # What a circle of parents leaves behind has repeated messages and never ends.
    circular = jumps.select(F.col("message_id").alias("leaf_id")).distinct()
    return paths.join(circular, "leaf_id", "left_anti")


def chosen_branches(messages: DataFrame, paths: DataFrame, branches: int = 1) -> DataFrame:
    """The leaves of the best ``branches`` of each tree: by mean score, then length, then id."""
    known = messages.select("message_id", "conv_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    scored = paths.join(known, "message_id").groupBy("leaf_id", "conv_id").agg(
        F.avg("score").alias("branch_score"), F.count("*").alias("n_messages"))
    best = W.partitionBy("conv_id").orderBy(
        F.desc("branch_score"), F.desc("n_messages"), F.asc("leaf_id"))
    return scored.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One formatted conversation per chosen branch, with its loss mask.

    ``messages`` has ``conv_id, message_id, parent_id, role, text, score``; message
    ids are unique over all conversations.  The result has ``conv_id, leaf_id,
    branch, branch_score, formatted, loss_spans``.
    """
    paths = root_to_leaf_paths(messages)
    chosen = chosen_branches(messages, paths, branches)
    contents = messages.select("message_id", F.coalesce("role", F.lit("")).alias("role"),
                               F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(chosen, "leaf_id").join(contents, "message_id")
    grouped = turns.groupBy("conv_id", "leaf_id", "branch", "branch_score").agg(
        F.sort_array(F.collect_list(F.struct("above", "role", "text")), asc=False).alias("turns"))
    return grouped.select("conv_id", "leaf_id", "branch", "branch_score",
                          formatted(F.col("turns")).alias("formatted"),
                          loss_mask(F.col("turns")).alias("loss_spans"))


def as_trees(turns: DataFrame) -> DataFrame:
    """Conversations in turns as trees in which each turn answers the one before."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("-none"))
    return turns.select("conv_id", "role", "text", place.alias("place")).select(
        "conv_id", "role", "text", F.lit(None).cast("double").alias("score"),
        F.concat_ws("/", name, F.col("place").cast("string")).alias("message_id"),
        F.when(F.col("place") > 1, F.concat_ws("/", name, (F.col("place") - 1).cast("string")))
        .alias("parent_id"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from the formatted texts alone."""
    turns = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return conversations.select(
        "conv_id", "formatted", parsed_turns(F.col("formatted")).alias("turns"),
        masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss_text"),
    ).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
