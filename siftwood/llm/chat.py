"""Reply trees: root-to-leaf paths by self-joins, branch ranking, chat formatting. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import removed, saved, shared_dir

# Fixed values of the chat template.
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """Text in which no control string can occur: every `<|` gets a second bar."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _header(role: Column) -> Column:
    """A role as one line."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role(header: Column) -> Column:
    parts = F.transform(F.split(header, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescaped(F.array_join(parts, "\\"))


def linear_tree(turns: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as a reply tree in which every turn answers the one before.

    Turns that tie are ordered by role and text; repeated rows are turns of their own.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select(F.col("conv_id").alias("tree_id"), F.row_number().over(order).cast("long").alias("node_id"), "role", "text")
    return rows.withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)).withColumn("score", F.lit(0.0))


def branches(tree: DataFrame, work: str) -> DataFrame:
    """All root-to-leaf paths of tree(tree_id, node_id, parent_id): rows (tree_id, leaf, node_id, up), up steps above the leaf.

    Path doubling: in round k every known (leaf, node) pair gains the node 2**k steps up, and the
    pointers double by a self-join, so rounds grow as the logarithm of the depth and rows are those
    of the result. A parent that isn't in the tree counts as none. Replies in a cycle belong to
    no root and raise ValueError if a leaf hangs below them.
    """
    spark = tree.sparkSession
    ids = tree.select("tree_id", "node_id", "parent_id").distinct()
    known = ids.select("tree_id", F.col("node_id").alias("parent_id")).distinct()
    up = saved(ids.join(known, ["tree_id", "parent_id"]).select("tree_id", "node_id", F.col("parent_id").alias("to")), f"{work}/up0")
    inner = up.select("tree_id", F.col("to").alias("node_id")).distinct()
    leaves = ids.select("tree_id", "node_id").distinct().join(inner, ["tree_id", "node_id"], "left_anti")
    paths = saved(leaves.select("tree_id", F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("up")), f"{work}/paths0")
    k, most = 0, None
    while not up.isEmpty():
        most = ids.count() if most is None else most
        if (1 << k) > most:
            raise ValueError("replies form a cycle")
        step = paths.join(up, ["tree_id", "node_id"]).select("tree_id", "leaf", F.col("to").alias("node_id"), (F.col("up") + (1 << k)).alias("up"))
        paths = saved(paths.unionByName(step), f"{work}/paths{k + 1}")
        far = up.select("tree_id", F.col("node_id").alias("from"), F.col("to").alias("node_id")).join(up, ["tree_id", "node_id"])
        up = saved(far.select("tree_id", F.col("from").alias("node_id"), "to"), f"{work}/up{k + 1}")
        removed(spark, f"{work}/paths{k}")
        removed(spark, f"{work}/up{k}")
        k += 1
    return paths


def format_trees(tree: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """Format the best branches of each reply tree as conversations.

    tree: tree_id, node_id, parent_id, role, text, score; node ids are unique in a tree. A branch
    scores the mean of its nodes' scores (null: 0); branches rank by score, then by leaf id, and
    the first per_tree stay (None: all). Returns tree_id, leaf, rank, score, n_turns, formatted
    (the conversation with marked, escaped turns) and loss_spans (1-based start and length, in code
    points of formatted, of every assistant text). Rows of a null tree_id make one tree. Null roles
    and texts are empty. An empty table gives no rows. Extra columns are ignored. Control strings inside texts and roles are escaped
    reversibly; read_turns() and loss_text() undo it.
    """
    work = shared_dir(tree.sparkSession)
    tree = tree.select(F.struct(F.col("tree_id").alias("id")).alias("tree_id"), "node_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    tree = saved(tree, f"{work}/tree")  # read again by each round, which take its narrow columns only
    paths = branches(tree, work)  # tree ids are structs here: joins match those that hold a null
    scores = tree.select("tree_id", "node_id", "score")
    ranked = paths.join(scores, ["tree_id", "node_id"]).groupBy("tree_id", "leaf").agg(F.avg("score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf")))
    if per_tree is not None:
        ranked = ranked.filter(F.col("rank") <= per_tree)
    turn = F.concat(F.lit(START), _header(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END))
    said = F.length(escaped(F.col("text")))
    nodes = tree.select("tree_id", "node_id", turn.alias("turn"), F.length(turn).cast("long").alias("n"), F.when(F.col("role") == "assistant", said).otherwise(F.lit(-1)).cast("long").alias("said"))
    rows = paths.join(ranked, ["tree_id", "leaf"]).join(nodes, ["tree_id", "node_id"])
    joined = rows.groupBy("tree_id", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn", "n", "said"))).alias("turns"))
    ends = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, t: F.struct(
            (s.end + t.n).alias("end"),
            F.when(t.said >= 0, F.concat(s.spans, F.array(F.struct((s.end + t.n - F.lit(len(END)) - t.said + 1).alias("start"), t.said.alias("length"))))).otherwise(s.spans).alias("spans"),
        ),
        lambda s: s.spans,
    )
    return joined.select(F.col("tree_id.id").alias("tree_id"), "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"), F.concat_ws("", F.transform("turns", lambda t: t.turn)).alias("formatted"), ends.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    body = lambda b: F.substr(b, F.lit(len(START) + 1))
    return F.transform(blocks, lambda b: F.struct(_role(F.substring_index(body(b), "\n", 1)).alias("role"), unescaped(F.substr(body(b), F.length(F.substring_index(body(b), "\n", 1)) + 2)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescaped(F.substr(formatted, s.start.cast("int"), s.length.cast("int")))))


def with_loss_text(formatted: DataFrame) -> DataFrame:
    return formatted.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
