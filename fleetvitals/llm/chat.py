"""Conversations from reply trees: paths by self-joins, one formatted text per chosen path.

Paths are enumerated by iterative self-joins that double: round k knows of every
message the ancestor 2^k steps up, so a path of n messages takes log2(n) rounds up
and as many down. All of it is DataFrame operations.

Template, per turn: <|im_start|>role, a line feed, the text, <|im_end|> and a line
feed. Inside roles and texts "<", any backslashes and "|" get one more backslash
before the bar, so that no control string is left; that is undone exactly. In roles
a backslash is then written as \\b and a line feed as \\n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.session import stored

START, END = "<|im_start|>", "<|im_end|>\n"
_OPEN, _CLOSED = r"<(\\*)\|", r"<\\$1|"
_ESCAPED, _PLAIN = r"<\\(\\*)\|", r"<$1|"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN, _CLOSED)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, _PLAIN)


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))
    return unescaped(plain)


def best_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree_id, leaf, branch, place, node): the messages of the chosen root-to-leaf paths.

    `messages` has tree_id, node (distinct in its tree), parent (null or unknown: a root)
    and score (null: 0). A path's score is the sum of its messages'; paths of a tree
    are ranked by it, ties to the smaller leaf, and the first `branches` are kept (None:
    all). place counts from 0 at the root. Messages on or under a cycle have no root and
    so no path.
    """
    key = ["tree_id", "node"]
    nodes = messages.select("tree_id", "node", "parent", F.coalesce(
        F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select("tree_id", F.col("node").alias("parent"), F.lit(True).alias("known"))
    nodes = stored(_equal_join(nodes, known, ["tree_id", "parent"], "left").select(
        *key, F.when(F.col("known"), F.col("parent")).alias("parent"), "score"), "nodes")
    limit = nodes.count()

    # sums: per message the score of the 2^k messages from it upwards, and what lies above
    # them. Only messages with something above them go on to the next round.
    sums = nodes.select(*key, F.col("parent").alias("up"), F.col("score").alias("total"))
    ups: list[DataFrame] = []
    while True:
        rising = sums.where("up is not null")
        if rising.isEmpty() or 2 ** len(ups) > limit:
            break
        ups.append(rising.select(*key, "up"))
        above = sums.select("tree_id", F.col("node").alias("up"), F.col("up").alias("next"),
                            F.col("total").alias("more"))
        risen = _equal_join(rising, above, ["tree_id", "up"], "inner").select(
            *key, F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        sums = stored(sums.where("up is null").unionByName(risen), "sums")

    parents = nodes.where("parent is not null").select("tree_id", F.col("parent").alias("node"))
    leaves = _equal_join(sums.where("up is null"), parents.distinct(), key, "left_anti")
    if branches is not None:
        order = Window.partitionBy("tree_id").orderBy(F.col("total").desc(), "node")
        leaves = leaves.withColumn("branch", F.row_number().over(order)).where(
            F.col("branch") <= branches)
    else:
        order = Window.partitionBy("tree_id").orderBy(F.col("total").desc(), "node")
        leaves = leaves.withColumn("branch", F.row_number().over(order))
    paths = leaves.select("tree_id", F.col("node").alias("leaf"), "branch", "node",
                          F.lit(0).alias("above_leaf"))
    for k in reversed(range(len(ups))):
        paths = stored(paths, "paths")
        higher = _equal_join(paths, ups[k], key, "inner").select(
            "tree_id", "leaf", "branch", F.col("up").alias("node"),
            (F.col("above_leaf") + 2 ** k).alias("above_leaf"))
        paths = paths.unionByName(higher)
    paths = stored(paths, "paths")
    return paths


def _equal_join(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Join by columns of one name on both sides; a null tree is a tree like others."""
    right = right.withColumnsRenamed({n: f"_{n}" for n in names})
    on = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    return left.join(right, on, how).drop(*[f"_{n}" for n in names])


def formatted(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree_id, leaf, branch, n_turns, formatted, loss_spans) of every chosen path.

    `messages` also has role and text (null: empty). loss_spans are the places, in code
    points from 0 and up to the end without it, of the texts that a model is trained on:
    each assistant text, escaped as it stands there.
    """
    paths = best_paths(messages, branches)
    turns = _equal_join(paths, messages.select("tree_id", "node", "role", "text"),
                        ["tree_id", "node"], "inner")
    head = F.concat(F.lit(START), escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    turns = turns.select(
        "tree_id", "leaf", "branch",
        F.struct((-F.col("above_leaf")).alias("place"), head.alias("head"),
                 escaped(F.coalesce("text", F.lit(""))).alias("body"),
                 F.coalesce(F.col("role") == TRAINED_ROLE, F.lit(False)).alias("trained"),
                 ).alias("turn"))
    grouped = turns.groupBy("tree_id", "leaf", "branch").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"))
    text = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    span = "array<struct<start:int,stop:int>>"
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans")),
        lambda done, t: F.struct(
            (done["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(t["trained"], F.array_append(done["spans"], F.struct(
                (done["at"] + F.length(t["head"])).alias("start"),
                (done["at"] + F.length(t["head"]) + F.length(t["body"])).alias("stop"))))
            .otherwise(done["spans"]).alias("spans")),
        lambda done: done["spans"])
    return grouped.select("tree_id", "leaf", "branch", F.size("turns").cast("long").alias("n_turns"),
                          text.alias("formatted"), spans.alias("loss_spans"))


def parsed(text: Column) -> Column:
    """array<struct<role, text>> of the turns of a formatted text."""
    pieces = F.split(text, r"<\|im_end\|>\n")
    turns = F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))),
                        lambda t: F.substring(t, F.lit(len(START) + 1), F.length(t)))
    return F.transform(turns, lambda t: F.struct(
        unescaped_role(F.substring_index(t, "\n", 1)).alias("role"),
        unescaped(F.substring(t, F.instr(t, "\n") + 1, F.length(t))).alias("text")))


def loss_texts(text: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescaped(
        F.substring(text, s["start"] + 1, s["stop"] - s["start"])))


def chains(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees of one branch.

    Each turn answers the one before it. Rows of equal turn follow each other by role
    and text; null turns come first; rows without conv_id are one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select(F.col("conv_id").alias("tree_id"), "role", "text",
                           F.row_number().over(order).cast("long").alias("node"))
    return numbered.select("*", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                           F.lit(1.0).alias("score"))
