"""Chat formatting: reply trees to conversations, DataFrame functions only.

``reply_paths`` numbers every message's ancestors by self-joins with pointer doubling
(log2 of the largest tree joins), ranks the root-to-leaf branches of each tree by score
and returns the messages of the chosen ones. ``format_paths`` writes each path as one text
with turn marks and the character spans of the loss mask; ``read_back`` reads it again.

Defined cases: rows without a tree id are left out; a null role or text is empty; a parent
that isn't there makes its child a root; messages on a reply cycle reach no root and are
left out; equal scores go to the smaller leaf id; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

HEAD, MID, TAIL = "### ", ": ", "</turn>\n"
#: Control characters inside texts and roles become a backslash and a letter.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as reply trees: each row answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").alias("tree_id"), F.row_number().over(order).cast("long").alias("msg_id"), "role", "text"
    ).select("*", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), F.lit(0.0).alias("score"))


def reply_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree_id, msg_id, parent_id, role, text, score) to the messages of each tree's
    ``branches`` best root-to-leaf paths by mean score (None: all paths):
    tree_id, leaf_id, branch_rank, path_score, depth, role, text."""
    nodes = messages.filter("tree_id is not null and msg_id is not null").dropDuplicates(["tree_id", "msg_id"]) \
        .select("tree_id", "msg_id", "parent_id", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    slim = written(nodes.select("tree_id", "msg_id", "parent_id", "score"), "reply-nodes")
    sizes = slim.groupBy("tree_id").agg(F.count("*").alias("tree_n"))
    ids = slim.select("tree_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("known"))
    state = slim.join(ids, ["tree_id", "parent_id"], "left").join(sizes, "tree_id").select(
        "tree_id", "tree_n", F.col("msg_id").alias("node"), F.when(F.col("known"), F.col("parent_id")).alias("jump"), F.lit(1).cast("long").alias("n"), F.col("score").alias("total")
    )
    largest = sizes.agg(F.max("tree_n")).first()[0] or 1
    rounds, levels = math.ceil(math.log2(largest)) if largest > 1 else 0, []
    done = state.filter("tree_n <= 1")
    for k in range(rounds):  # a tree takes part until the jumps are longer than it has nodes
        open_ = state.filter(F.col("tree_n") > 2**k)
        levels.append(open_.select("tree_id", "node", "jump").filter("jump is not null"))
        up = open_.select("tree_id", F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("n").alias("more"), F.col("total").alias("added"))
        state = written(open_.join(up, ["tree_id", "jump"], "left").select(
            "tree_id", "tree_n", "node", F.col("next").alias("jump"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), (F.col("total") + F.coalesce("added", F.lit(0.0))).alias("total")
        ), "reply-jumps")
        done = done.unionByName(state.filter(F.col("tree_n") <= 2 ** (k + 1)))
    rooted = done.filter("jump is null")  # what still has an ancestor after all rounds is on a cycle
    leaves = rooted.join(slim.select("tree_id", F.col("parent_id").alias("node")).filter("node is not null").distinct(), ["tree_id", "node"], "left_anti") \
        .select("tree_id", F.col("node").alias("leaf_id"), (F.col("total") / F.col("n")).alias("path_score"))
    ranked = leaves.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("path_score"), "leaf_id")))
    chosen = (ranked if branches is None else ranked.filter(F.col("branch_rank") <= branches)).withColumn("node", F.col("leaf_id"))
    for level in reversed(levels):
        further = chosen.join(level, ["tree_id", "node"]).select("tree_id", "leaf_id", "path_score", "branch_rank", F.col("jump").alias("node"))
        chosen = written(chosen.select(further.columns).unionByName(further), "reply-paths")
    return chosen.join(rooted.select("tree_id", "node", F.col("n").alias("depth")), ["tree_id", "node"]).join(
        nodes.select("tree_id", F.col("msg_id").alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree_id", "node"]
    ).select("tree_id", "leaf_id", "branch_rank", "path_score", "depth", "role", "text")


def format_paths(paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per path: tree_id, leaf_id, branch_rank, formatted, loss_spans (start and
    length in code points of each text of ``loss_role``, in order)."""
    so_far = Window.partitionBy("tree_id", "leaf_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = paths.withColumns({"body": escape(F.col("text")), "head": F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(MID))}) \
        .withColumn("piece", F.concat("head", "body", F.lit(TAIL))) \
        .withColumn("start", F.coalesce(F.sum(F.length("piece")).over(so_far), F.lit(0)) + F.length("head"))
    one = F.struct("depth", "piece", F.when(F.col("role") == loss_role, F.struct("start", F.length("body").cast("long").alias("length"))).alias("span"))
    return turns.groupBy("tree_id", "leaf_id", "branch_rank").agg(F.array_sort(F.collect_list(one)).alias("t")).select(
        "tree_id", "leaf_id", "branch_rank", F.array_join("t.piece", "").alias("formatted"), F.filter("t.span", lambda s: s.isNotNull()).alias("loss_spans")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, both read from ``formatted``."""
    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(HEAD) + 1, 2_147_483_647)
        role = F.substring_index(body, MID, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(body, F.length(role) + len(MID) + 1)).alias("text"))

    pieces = F.filter(F.split(F.col("formatted"), TAIL.replace("\n", "\\n")), lambda p: p != "")
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_text": F.array_join(masked, "")})


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(planted)
    back = read_back(format_paths(reply_paths(linear_messages(rows))))
    return back.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
with r as (
  select conv_id, cast(turn as bigint) turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<:]', '', 'g')) + 4 + 2 + 8 as size from r)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(size) as bigint) as formatted_chars
from e group by conv_id
"""
