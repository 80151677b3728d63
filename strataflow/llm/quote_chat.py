"""Chat formatting by quotation linking, in DataFrame functions only.

A line's quote level is the number of ``>`` before it. Maximal runs of lines of one level above 0 are
quoted passages. Passages, their paragraphs and their lines are normalised (white space to one space,
lower case, trimmed), hashed, and looked up among the units of any length that earlier messages of the
same conversation wrote themselves: of equal units the latest before the quoting turn counts, found in
spans of ``SPAN`` turns and then over spans, so a line said and quoted often makes no square of pairs. The parent of a message is the origin of its first level-1 passage
that has one (longest unit first, then the latest message). Parents make trees of replies; the walk that
enters and leaves every message of a tree, replies in order of turn, is ranked as a list by pointer jumping,
which gives root, depth and place in reply order at once. Ordered by (conv_id, root_turn, reply_order), each
message stands behind the one it answers and all the answers to earlier answers, with its quotes taken out, so
conversations are built without gathering one in a row or task.

Defined cases: null texts have an empty body and no quotes; messages with a null conversation or
turn, and quotes of nothing said before, get no parent and are their own root; different messages of one turn
share root, depth and place, after the latest of their parents; repeated rows get equal rows; a passage never links to its own or a later turn; extra columns aren't read; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_written, written

MARK = "^[ \\t]*(>[ \\t]?)+"
#: Turns that are ordered as one when the latest like unit is looked up.
SPAN = 256


def _norm(c: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(c, "[\\x20\\x09-\\x0D]+", " ")))


def _units(text: Column) -> Column:
    """Normalised whole, paragraphs and lines of a text."""
    parts = F.concat(F.split(text, "\\n[ \\t]*\\n"), F.split(text, "\\n"))
    return F.filter(F.array_distinct(F.concat(F.array(_norm(text)), F.transform(parts, _norm))), lambda x: x != "")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, mid, lines [(level, content)], body (unquoted lines)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(
        F.split(text, "\\n"),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARK, "").alias("content")),
    )
    out = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.xxhash64("conv_id", "turn", "role", text).alias("mid"), lines.alias("lines"))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x.level == 0), lambda x: x.content), "\n")
    return out.withColumn("body", F.regexp_replace(F.regexp_replace(own, "\\n{3,}", "\n\n"), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", ""))


def passages(messages: DataFrame) -> DataFrame:
    """mid, conv_id, turn, level, first (line), passage: the quoted passages of parsed messages."""
    quoting = messages.where(F.exists("lines", lambda x: x.level > 0)).select("mid", "conv_id", "turn", "lines").dropDuplicates(["mid"])
    rows = quoting.select("mid", "conv_id", "turn", F.posexplode("lines").alias("pos", "line")).select("mid", "conv_id", "turn", "pos", "line.level", "line.content").where("level > 0")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("mid", "level").orderBy("pos"))
    runs = rows.withColumn("run", run).groupBy("mid", "conv_id", "turn", "level", "run")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x.content), "\n")
    return runs.agg(F.min("pos").alias("first"), joined.alias("passage")).drop("run")


def _latest(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """conv_id, hash, unit, turn, said_turn: for every quoted unit the latest earlier turn that said it."""
    unit = ["conv_id", "hash", "unit"]
    said = said.join(quoted.select(*unit).distinct(), unit, "left_semi")
    rows = said.select(*unit, "turn", F.col("turn").alias("said_turn")).unionByName(quoted.select(*unit, "turn", F.lit(None).cast("long").alias("said_turn")))
    rows = rows.groupBy(*unit, "turn").agg(F.max("said_turn").alias("own")).withColumn("span", F.floor(F.col("turn") / SPAN))
    before = lambda order, *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max("own").over(before("turn", *unit, "span")))
    far = rows.groupBy(*unit, "span").agg(F.max("own").alias("top")).withColumn("far", F.max("top").over(before("span", *unit)))
    found = near.join(far.select(*unit, "span", "far"), [*unit, "span"])
    return found.select(*unit, "turn", F.coalesce("near", "far").alias("said_turn")).where("said_turn is not null")


def linked_passages(messages: DataFrame) -> DataFrame:
    """Every quoted passage with an origin: mid, conv_id, turn, level, first, parent."""
    quoted = passages(messages).where("conv_id is not null and turn is not null")
    quoted = quoted.select("mid", "conv_id", "turn", "level", "first", F.explode(_units(F.col("passage"))).alias("unit")).withColumn("hash", F.xxhash64("unit"))
    own = F.array_join(F.transform("lines", lambda x: F.when(x.level == 0, x.content).otherwise("")), "\n")
    said = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(_units(own)).alias("unit")).withColumn("hash", F.xxhash64("unit"))
    found = quoted.join(_latest(quoted, said), ["conv_id", "hash", "unit", "turn"])
    return found.groupBy("mid", "conv_id", "turn", "level", "first").agg(F.max(F.struct(F.length("unit"), "said_turn")).getField("said_turn").alias("parent"))


def _next_sibling(kids: DataFrame) -> DataFrame:
    """conv_id, turn, parent, next: the next turn with the same parent, found in spans of turns and then over spans."""
    rows = kids.withColumn("span", F.floor(F.col("turn") / SPAN))
    near = rows.withColumn("near", F.lead("turn").over(Window.partitionBy("conv_id", "parent", "span").orderBy("turn")))
    first = rows.groupBy("conv_id", "parent", "span").agg(F.min("turn").alias("first"))
    far = first.withColumn("far", F.lead("first").over(Window.partitionBy("conv_id", "parent").orderBy("span"))).drop("first")
    return near.join(far, ["conv_id", "parent", "span"]).select("conv_id", "turn", "parent", F.coalesce("near", "far").alias("next"))


def reply_order(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth, reply_order of all messages of parents(conv_id, turn, parent) and of their
    roots. Every message is entered and left once; a step leads from one event to the next, and each round of
    jumping doubles the steps, while the events passed are counted."""
    kids = written(_next_sibling(parents.select("conv_id", "turn", "parent")), "replies")
    tops = kids.select("conv_id", F.col("parent").alias("turn")).distinct().join(kids, ["conv_id", "turn"], "left_anti")
    nodes = kids.unionByName(tops, allowMissingColumns=True)
    first = kids.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    event = lambda turn, side: F.struct(turn.alias("turn"), F.lit(side).alias("side"))
    enter = nodes.join(first, ["conv_id", "turn"], "left").select("conv_id", event(F.col("turn"), 0).alias("at"), F.when(F.col("child").isNotNull(), event(F.col("child"), 0)).otherwise(event(F.col("turn"), 1)).alias("to"))
    leave = nodes.select("conv_id", event(F.col("turn"), 1).alias("at"), F.when(F.col("next").isNotNull(), event(F.col("next"), 0)).when(F.col("parent").isNotNull(), event(F.col("parent"), 1)).alias("to"))
    walk = enter.unionByName(leave).select("conv_id", "at", "to", F.col("at.turn").alias("end"), (1 - F.col("at.side")).cast("long").alias("entered"), F.col("at.side").cast("long").alias("left"))
    now = written(walk, "walk")
    while now.where("to is not null").limit(1).count():
        ahead = now.select("conv_id", F.col("at").alias("to"), F.col("to").alias("to_"), F.col("end").alias("end_"), F.col("entered").alias("entered_"), F.col("left").alias("left_"))
        add = lambda c: (F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c)
        after = written(now.join(ahead, ["conv_id", "to"], "left").select("conv_id", "at", F.col("to_").alias("to"), F.coalesce("end_", "end").alias("end"), add("entered"), add("left")), "walk")
        drop_written(now)
        now = after
    entered = now.where("at.side = 0").select("conv_id", F.col("at.turn").alias("turn"), F.col("end").alias("root_turn"), (F.col("left") - F.col("entered")).alias("depth"), "entered")
    whole = entered.where("turn = root_turn").select("conv_id", "root_turn", F.col("entered").alias("size"))
    return entered.join(whole, ["conv_id", "root_turn"]).select("conv_id", "turn", "root_turn", "depth", (F.col("size") - F.col("entered")).alias("reply_order"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quotes, n_linked, parent_turn, root_turn, depth, reply_order, chat of every message."""
    rows = parsed(messages.select("conv_id", "turn", "role", "text"))
    links = written(linked_passages(rows), "quote-links")
    quotes = passages(rows).groupBy("mid").agg(F.count(F.lit(1)).alias("n_quotes"))
    linked = links.groupBy("mid").agg(F.count(F.lit(1)).alias("n_linked"))
    parent = links.where("level = 1").groupBy("mid", "conv_id", "turn").agg(F.min_by("parent", "first").alias("parent_turn"))
    # Different messages of one turn share its place: the latest of their parents counts.
    order = reply_order(parent.groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("parent"))).withColumnRenamed("root_turn", "root")
    out = rows.join(quotes, "mid", "left").join(linked, "mid", "left").join(parent.select("mid", "parent_turn"), "mid", "left").join(order, ["conv_id", "turn"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", "turn", "role", "body", zero("n_quotes"), zero("n_linked"), "parent_turn", F.coalesce("root", "turn").alias("root_turn"), zero("depth"), zero("reply_order"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n")).alias("chat"),
    )


def ordered(formatted: DataFrame) -> DataFrame:
    """Formatted messages in order of conversation, thread and reply, dealt by range, so that files hold
    conversations one message behind the other, however long they are."""
    return formatted.orderBy("conv_id", "root_turn", "reply_order", "turn", "role", "body")
