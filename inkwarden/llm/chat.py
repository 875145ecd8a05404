"""Chat formatting: reply trees, ranked branches, one conversation a chosen path. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Fixed values of the template: what opens and closes a turn, and the escapes.
# Every control string begins with < or [, so no text keeps either: \ is \e, < is \l, [ is \b, and in roles a new line is \n.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
TAUGHT = "assistant"


def escape(text: Column) -> Column:
    """The text without any control string; reversible."""
    for plain, escaped in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    """Back again: a backslash is always the first of a pair, so the order last to first is safe."""
    for plain, escaped in reversed(_ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(root, rank, branch_score, leaf, up, id): the nodes of the best `keep` root-to-leaf paths of each tree.

    messages has id (unique), parent and score. up is 0 at the leaf and grows towards the root. A
    path's score is the sum of its nodes' scores (null: 0); equal ones rank by leaf. A parent that is
    not in the table counts as none. Self-joins double the distance they bridge, so a tree of depth d
    takes about log2(d) rounds; each round's table is written to the checkpoint folder as
    Parquet (a checkpoint of a union can't be joined again). Nodes on or
    under a cycle have no root and give no path.
    """
    nodes = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("id").alias("known"))
    state = nodes.join(known, F.col("parent") == F.col("known"), "left").select("id", F.col("known").alias("anc"), F.coalesce("known", "id").alias("top"), F.col("score").alias("total"))
    state = stored(state)
    jumps, count = [], None
    while True:
        open_ends = state.where(F.col("anc").isNotNull())
        left = open_ends.count()
        if not left:
            break
        count = state.count() if count is None else count
        if 2 ** len(jumps) > count:
            state = state.where(F.col("anc").isNull())
            break
        jumps.append(open_ends.select("id", "anc"))
        # Only nodes that aren't at their root yet are joined; in the end these are those of long conversations.
        ahead = state.select(F.col("id").alias("at"), F.col("anc").alias("anc2"), F.col("top").alias("top2"), F.col("total").alias("total2"))
        further = open_ends.join(ahead, F.col("anc") == F.col("at")).select("id", F.col("anc2").alias("anc"), F.col("top2").alias("top"), (F.col("total") + F.col("total2")).alias("total"))
        state = stored(state.where(F.col("anc").isNull()).unionByName(further))
    parents = jumps[0].select(F.col("anc").alias("known")) if jumps else known.where(F.lit(False))
    leaves = state.join(parents, F.col("id") == F.col("known"), "left_anti")
    best = Window.partitionBy("top").orderBy(F.col("total").desc(), F.col("id"))
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    path = chosen.select(F.col("top").alias("root"), "rank", F.col("total").alias("branch_score"), F.col("id").alias("leaf"), F.lit(0).cast("long").alias("up"), "id")
    # Each step doubles the nodes known of a path; a row and what it leads to come from one join, so the plan is a chain.
    for power in reversed(range(len(jumps))):
        further = jumps[power].withColumnRenamed("id", "at")
        both = F.array(F.struct("up", "id"), F.when(F.col("anc").isNotNull(), F.struct((F.col("up") + 2**power).alias("up"), F.col("anc").alias("id"))))
        path = path.join(further, F.col("id") == F.col("at"), "left").select("root", "rank", "branch_score", "leaf", F.explode(F.array_compact(both)).alias("node")).select("root", "rank", "branch_score", "leaf", "node.*")
    return path


def format_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(root, rank, branch_score, leaf, formatted, mask): one conversation a chosen path.

    messages has id, parent, role, text and score. formatted is the whole string; mask holds the
    (start, length) of what the model is taught there, in code points from 0: assistant texts, escaped,
    without their markers. Null roles and texts are empty. A conversation becomes one string, so its
    turns meet in one task; nothing else does.
    """
    turns = messages.select("id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    path = branches(messages, keep).withColumnRenamed("id", "node")
    rows = path.join(turns, F.col("node") == F.col("id"))
    text, head = escape(F.col("text")), F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("root", "rank", "branch_score", "leaf", "up", head.alias("head"), text.alias("body"), (F.col("role") == TAUGHT).alias("loss"))
    keys = ("root", "rank", "branch_score", "leaf")
    # Where each turn's text begins is a running sum in the partition that the turns meet in anyway.
    earlier = Window.partitionBy(*keys).orderBy(F.col("up").desc()).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + F.lit(len(CLOSE))
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(earlier), F.lit(0)) + F.length("head"))
    turn = F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("whole"), F.struct("start", F.length("body").cast("long").alias("length")).alias("place"), "loss")
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["place"])
    return whole.select(*keys, F.array_join(F.col("turns.whole"), "").alias("formatted"), mask.alias("mask"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as (role, text), unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    bodies = F.transform(parts, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    return F.transform(bodies, lambda b: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b))).alias("text")))


def taught(formatted: Column, mask: Column) -> Column:
    """All text of a formatted conversation under its loss mask, unescaped, in order."""
    part = lambda m: F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int"))
    return F.array_join(F.transform(mask, lambda m: unescape(part(m))), "")


def chains(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Reply trees of plain conversations: each turn answers the one before.

    Turns of equal number (repeated rows) follow each other by role and text; a null number comes first. The
    result is a written table, (id, parent, conv_id, role, text, score).
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # Ids are numbers that a node has from its place among the sorted rows; the written table makes them final.
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("id", F.monotonically_increasing_id())
    rows = rows.withColumn("parent", F.lag("id").over(Window.partitionBy("conv_id").orderBy("n")))
    return stored(rows.select("id", "parent", "conv_id", "role", "text", F.lit(0.0).alias("score")))
