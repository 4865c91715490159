"""Chat formatting from reply trees, in DataFrame operations only.

Iterated self-joins double the reach of every message's pointer to its ancestors, so a tree of depth d takes log2(d)
rounds. They give each leaf the score of its branch; the best branches of a conversation are walked back over the same
pointers and each becomes one formatted text with a loss mask. Reading back is part of the module."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.session import cut_lineage

HEADS = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
OPEN, CLOSE = "### ", " </turn>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    r"""`\` and `#` get a backslash, `</` becomes `<\/`: no control string is left in the text."""
    return F.regexp_replace(F.regexp_replace(text, r"([\\#])", r"\\$1"), "</", r"<\\/")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _head(role: Column) -> Column:
    own = F.concat(F.lit("@"), F.regexp_replace(escape(role), ":", r"\\:"))
    for name, head in HEADS.items():
        own = F.when(role == name, head).otherwise(own)
    return own


def _role(head: Column) -> Column:
    own = unescape(F.substring(head, 2, 1 << 30))
    for name, known in HEADS.items():
        own = F.when(head == known, name).otherwise(own)
    return own


def branches(messages: DataFrame, best: int = 1) -> DataFrame:
    """(conv, leaf, place, node) of the `best` branches of each conversation; place counts from the root, from 0.

    messages: conv, node, parent, score, a row per (conv, node). A parent that is not there makes a root; messages on a circle of replies have
    none and are left out. Branches rank by the sum of their scores, then by depth, then by the smaller leaf."""
    nodes = messages.select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("known"))
    step = cut_lineage(nodes.join(known, ["conv", "parent"], "left").select(
        "conv", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"),
        F.col("score").alias("total")))
    total = step.count()
    reach, ended, held = [], [], None  # reach[k]: where the pointers of messages lead after 2^k steps
    while True:
        open_, done = step.where("up is not null"), step.where("up is null")
        reach.append(open_.select("conv", "node", "up"))
        ended.append(done)
        if (1 << (len(reach) - 1)) > total or not open_.take(1):
            break
        # only messages that have not met their root go on; the ended ones of their conversations answer them
        live = open_.select("conv").distinct()
        held = cut_lineage((done if held is None else held.union(done)).join(live, "conv", "left_semi"))
        over = open_.union(held.select(*open_.columns)).select(
            "conv", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"),
            F.col("total").alias("total2"))
        step = cut_lineage(open_.join(over, ["conv", "up"], "left").select(
            "conv", "node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total")))
    rooted = reduce(DataFrame.union, ended)
    parents = reach[0].select("conv", F.col("up").alias("node"))
    leaves = rooted.join(parents, ["conv", "node"], "left_anti")
    order = W.partitionBy("conv").orderBy(F.desc("total"), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    paths = cut_lineage(chosen.select("conv", F.col("node").alias("leaf"), (F.col("depth") - 1).alias("place"), "node"))
    for k in reversed(range(len(reach) - 1)):
        back = paths.where(F.col("place") >= 1 << k).join(reach[k], ["conv", "node"]).select(
            "conv", "leaf", (F.col("place") - (1 << k)).alias("place"), F.col("up").alias("node"))
        paths = paths.union(cut_lineage(back))
    return paths


def format_turns(turns: DataFrame, keys: list[str]) -> DataFrame:
    """One row per `keys` with `formatted` and `mask`, an array of (start, length) in characters of the text to learn.

    turns: the keys, place, role, text; null roles and texts are empty. A conversation is one text, so its turns meet
    in one task; lengths are summed before that."""
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    piece = turns.select(*keys, "place", (role == LEARNED).alias("learned"),
                         F.concat(F.lit(OPEN), _head(role), F.lit(": ")).alias("front"), text.alias("body"))
    size = F.length("front") + F.length("body") + len(CLOSE)
    before = W.partitionBy(*keys).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    piece = piece.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("front"))
    span = F.when(F.col("learned"), F.struct(F.col("at").alias("start"), F.length("body").alias("length")))
    whole = F.concat("front", "body", F.lit(CLOSE))
    rows = piece.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", whole.alias("whole")))).alias("turns"),
                                    F.array_sort(F.collect_list(span)).alias("mask"))
    return rows.select(*keys, F.array_join("turns.whole", "").alias("formatted"), "mask")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text again: an array of (role, text)."""
    pieces = F.filter(F.split(formatted, r" </turn>\n", -1), lambda x: x != "")
    head = r"(?s)^### ((?:[^:\\]|\\.)*+): (.*)$"
    return F.transform(pieces, lambda x: F.struct(_role(F.regexp_extract(x, head, 1)).alias("role"),
                                                  unescape(F.regexp_extract(x, head, 2)).alias("text")))


def read_learned(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    parts = F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"])))
    return F.array_join(parts, "")


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations whose turns answer each other in order, as messages. Rows of equal turn follow by role and text,
    null turns come first; a null conversation is one of its own."""
    conv = F.when(F.col("conv_id").isNull(), "").otherwise(F.col("conv_id").cast("string"))
    order = W.partitionBy("conv").orderBy("turn", "role", "text")
    node = F.row_number().over(order)
    rows = conversations.select(conv.alias("conv"), "turn", F.col("role").cast("string").alias("role"),
                                F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node", node.cast("long"))
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                       F.lit(0.0).alias("score"), "role", "text")


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """(conv, leaf, formatted, mask) for the best branches of reply trees (conv, node, parent, score, role, text).

    Of rows that repeat a (conv, node) one message stays: the one with the smallest parent, score, role and text, nulls
    first. Rows without a conv or a node are left out, and so are circles of replies. An empty table gives an empty
    result; a very long conversation is one text like any other. Other columns are not read."""
    one = F.min(F.struct("parent", "score", "role", "text")).alias("m")
    once = messages.where("conv is not null and node is not null").groupBy("conv", "node").agg(one)
    return _formatted(cut_lineage(once.select("conv", "node", "m.*")), best)


def _formatted(messages: DataFrame, best: int = 1) -> DataFrame:
    """The same of messages that are one row per (conv, node)."""
    turns = branches(messages, best).join(messages.select("conv", "node", "role", "text"), ["conv", "node"])
    return format_turns(turns, ["conv", "leaf"])


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text.

    Repeated rows are turns of their own, rows without a conv_id are one conversation, null roles and texts are empty; a
    conversation of any length is one text. An empty table gives an empty result. Other columns are not read."""
    rows = _formatted(cut_lineage(chains(conversations)))
    turns = read_turns(F.col("formatted"))
    rows = rows.select(F.expr("if(conv = '', null, cast(conv as bigint))").alias("conv_id"), "formatted",
                       turns.alias("turns"), read_learned(F.col("formatted"), F.col("mask")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
