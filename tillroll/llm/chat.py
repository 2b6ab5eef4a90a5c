"""Chat formatting of reply trees.

Paths are enumerated by self-joins that double the distance they reach: after
round k a leaf knows its ancestors up to 2**k steps away, so a thread of a
thousand replies takes ten rounds. Rounds carry ids only and are written to the
shared folder; texts are joined once, to the branches that were chosen.

Template, one turn after the other::

    ### <role>: <text></turn>\\n

``\\``, ``#``, ``<`` (and ``:`` in a role) are written ``\\\\``, ``\\h``, ``\\l``
and ``\\c``. So no text can hold a mark of the template, and every formatted
conversation can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import named, stored

TURN_END = "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark, code in (("#", "\\h"), ("<", "\\l")) + (((":", "\\c"),) if role else ()):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """Escaped backslashes pair up from the left, so cutting at them first
    leaves pieces in which every backslash begins a two-character code."""
    def piece(p):
        for mark, code in (("#", "\\h"), ("<", "\\l"), (":", "\\c")):
            p = F.replace(p, F.lit(code), F.lit(mark))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), named(column).cast("string")), F.lit(""))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pieces = F.split(formatted, TURN_END)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p):
        head = F.substring_index(p, ": ", 1)
        return F.struct(unescape(F.substr(head, F.lit(5))).alias("role"), unescape(F.substr(p, F.length(head) + 3)).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def paths(nodes: DataFrame) -> DataFrame:
    """nodes: (tree, node, parent) with unique ids. Returns (tree, leaf, node,
    up): every node on the way from a leaf up to its root. A parent that is
    not in the tree makes its child a root. Messages that reply to themselves
    around a cycle have no root and so lie on no path."""
    known = nodes.select("tree", F.col("node").alias("parent"))
    links = stored(nodes.filter("parent IS NOT NULL").join(known, ["tree", "parent"], "left_semi").select("tree", "node", "parent"), "chat-links")
    leaves = nodes.select("tree", "node").join(links.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    found = stored(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "chat-paths")
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jump, reach = links, 1
    while reach < largest and not jump.isEmpty():
        step = jump.select("tree", "node", F.col("parent").alias("next"))
        further = found.join(step, ["tree", "node"]).select("tree", "leaf", F.col("next").alias("node"), (F.col("up") + reach).alias("up"))
        found = stored(found.unionByName(further), "chat-paths")
        jump = stored(step.withColumnRenamed("next", "mid").join(
            jump.select("tree", F.col("node").alias("mid"), "parent"), ["tree", "mid"]).select("tree", "node", "parent"), "chat-jumps")
        reach *= 2
    if reach >= largest and not jump.isEmpty():  # only around a cycle
        rooted = found.join(links.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "leaf")
        found = found.join(rooted, ["tree", "leaf"], "left_semi")
    return found


def format_trees(messages: DataFrame, tree_col: str, node_col: str, parent_col: str, role_col: str = "role", text_col: str = "text",
                 score_col: str | None = None, top: int | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen root-to-leaf path: tree_col, leaf (as string),
    branch_rank, branch_score, n_turns, formatted, loss_spans
    (array<struct<start, length>> of code points in ``formatted``).

    Branches of a tree are ranked by the sum of their scores, highest first,
    then by leaf; ``top`` keeps so many of each tree (None: all).

    Nulls: a null text or role is empty, a null score 0, a null tree a tree of
    its own, a null parent a root. Repeated node ids of a tree: the smallest by
    (parent, role, text) counts. An empty table gives no rows; other columns of
    the input are ignored, whatever their name.
    """
    score = named(score_col).cast("double") if score_col else F.lit(0.0)
    body = F.struct(
        F.when(named(parent_col).isNotNull(), _key(parent_col)).alias("parent"),
        F.coalesce(named(role_col), F.lit("")).alias("role"), F.coalesce(named(text_col), F.lit("")).alias("text"), F.coalesce(score, F.lit(0.0)).alias("score"))
    every = messages.select(_key(tree_col).alias("tree"), _key(node_col).alias("node"), body.alias("body")).groupBy("tree", "node").agg(F.min("body").alias("body"))
    every = stored(every.select("tree", "node", "body.*"), "chat-nodes")
    found = paths(every.select("tree", "node", "parent"))
    branch = Window.partitionBy("tree").orderBy(F.col("branch_score").desc(), "leaf")
    ranked = (
        found.join(every.select("tree", "node", "score"), ["tree", "node"])
        .groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"), F.count("*").alias("n_turns"))
        .withColumn("branch_rank", F.row_number().over(branch))
    )
    if top is not None:
        ranked = ranked.filter(F.col("branch_rank") <= top)
    turns = found.join(ranked, ["tree", "leaf"]).join(every.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(": "))
    body = escape(F.col("text"))
    along = Window.partitionBy("tree", "leaf", "branch_rank", "branch_score", "n_turns").orderBy(F.col("up").desc())
    spans = (
        turns.withColumn("segment", F.concat(head, body, F.lit(TURN_END)))
        .withColumn("end", F.sum(F.length("segment").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("length", F.length(body).cast("long"))
        .withColumn("span", F.when(F.col("role").isin(*loss_roles), F.struct((F.col("end") - len(TURN_END) - F.col("length")).alias("start"), F.col("length").alias("length"))))
        .groupBy("tree", "leaf", "branch_rank", "branch_score", "n_turns")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "segment"))).alias("segments"), F.array_sort(F.collect_list("span")).alias("loss_spans"))
    )
    kind = messages.schema[tree_col].dataType
    return spans.select(
        F.when(F.col("tree") != "", F.expr("substr(tree, 2)")).cast(kind).alias(tree_col), F.expr("substr(leaf, 2)").alias("leaf"),
        "branch_rank", "branch_score", "n_turns",
        F.array_join(F.transform("segments", lambda s: s["segment"]), "").alias("formatted"), "loss_spans")


def chain(rows: DataFrame, tree_col: str, order_cols: list[str]) -> DataFrame:
    """Rows in order as a chain of replies: adds node and parent (1, 2, ...)."""
    order = Window.partitionBy(named(tree_col)).orderBy(*map(named, order_cols))
    out = rows.withColumn("node", F.row_number().over(order))
    return out.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
