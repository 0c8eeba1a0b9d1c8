"""Quotations in conversations: parsed, linked to the messages they come from, and left out of the reply order.

DataFrame expressions only. A line's level is the number of its leading ``>`` marks. A quoted passage is a run
of quoted lines of one level. Passages of every level, their
paragraphs and their lines are normalised (marks off, white space single, A-Z
lower) and hashed, and looked up among the hashes of what the messages of the conversation say themselves:
the whole message, its paragraphs, its lines. A passage comes from the earliest message that says it, if that
is an earlier one; so the lookup table is a pre-aggregated minimum and no pair of copies is formed. A message
replies to the message from which most lines come of its outermost quotes that are found (then the earliest).

Messages without such a link begin threads, in the order of their turns, and replies follow the message they
answer, depth first, in the order of their turns.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

MARKS = r"^[\x20\x09]*(?:>[\x20\x09]?)+"
#: A line that only says who wrote what is quoted below it.
ATTRIBUTION = r"(?i)^[\x20\x09]*(?:on\b.*\bwrote|.{1,80}\b(?:wrote|said|writes)):[\x20\x09]*$"


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.char_length(marks) - F.char_length(F.translate(marks, ">", ""))


def normalised(text: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (the text without quotes and their attributions), max_level, n_quoted and the passages.

    A passage is (level, lines). Line breaks at the ends of what is left are dropped. Null texts count as empty.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.struct(
        _level(line).alias("level"), F.regexp_replace(line, MARKS, "").alias("body"), line.alias("line")))

    def edges(step: int) -> Column:
        """Places of the quoted lines whose neighbour ``step`` away has another level."""
        level = lambda i: F.coalesce(F.get(F.col("lines"), i)["level"], F.lit(0))
        return F.filter(F.transform("lines", lambda x, i: F.when((x["level"] > 0) & (x["level"] != level(i + step)), i)), F.isnotnull)

    def passage(first: Column, last: Column) -> Column:
        inside = F.slice("lines", first + 1, last - first + 1)
        return F.struct(F.get(F.col("lines"), first)["level"].alias("level"), F.transform(inside, lambda x: x["body"]).alias("lines"))

    quoted = F.filter("lines", lambda x: x["level"] > 0)
    empty = F.array().cast("array<struct<level:int,lines:array<string>>>")
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(
        x["line"].rlike(ATTRIBUTION) & (F.coalesce(F.get(F.col("lines"), i + 1)["level"], F.lit(0)) > 0)))
    text = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^[\x20\x09-\x0D]*\n|\n[\x20\x09-\x0D]*$", "")
    has = F.size(quoted) > 0
    return messages.select("conv_id", "turn", "role", "text").withColumn("lines", lines).select(
        "conv_id", "turn", "role",
        F.when(has, text).otherwise(F.coalesce("text", F.lit(""))).alias("own"),
        F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).alias("max_level"), F.size(quoted).alias("n_quoted"),
        F.when(has, F.zip_with(edges(-1), edges(1), passage)).otherwise(empty).alias("passages"))


def _hashes(texts: Column) -> Column:
    return F.transform(F.filter(F.transform(texts, normalised), lambda t: t != ""), lambda t: F.md5(t.cast("binary")))


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) of the messages whose quotes come from an earlier message; the outermost level that finds one decides.

    messages: as from ``parsed``. Only conversations that hold a quote are looked at. Null conv_ids and turns link nothing.
    """
    quoting = messages.where("n_quoted > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL")
    said = messages.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi").where("turn IS NOT NULL")
    units = F.concat(F.array("own"), F.split("own", r"\n[\x20\x09]*\n"), F.split("own", "\n"))
    origins = (said.select("conv_id", "turn", F.explode(F.array_distinct(_hashes(units))).alias("hash"))
               .groupBy("conv_id", "hash").agg(F.min("turn").alias("origin")))
    paragraphs = lambda p: F.split(F.array_join(p["lines"], "\n"), r"\n[\x20\t]*\n")
    units = lambda p: F.concat(p["lines"], paragraphs(p), F.array(F.array_join(p["lines"], "\n")))
    asked = F.flatten(F.transform("passages", lambda p: F.transform(F.filter(units(p), lambda u: normalised(u) != ""), lambda u: F.struct(
        p["level"].alias("level"), F.md5(normalised(u).cast("binary")).alias("hash"), F.size(F.split(u, "\n")).cast("long").alias("votes")))))
    passages = quoting.select("conv_id", "turn", F.explode(asked).alias("asked")).select("conv_id", "turn", "asked.*")
    votes = (passages.join(origins, ["conv_id", "hash"]).where(F.col("origin") < F.col("turn"))
             .groupBy("conv_id", "turn", "level", "origin").agg(F.sum("votes").alias("votes")))
    return votes.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), "votes", -F.col("origin"))).alias("reply_to"))


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with ``part``, the number of their range of ``order`` between sampled bounds."""
    return stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")


def _followed(now: DataFrame, pointer: str, **merged: Column) -> DataFrame:
    """Rows (conv_id, turn, ...) that follow ``pointer`` to other rows' turns until it leads to none.

    ``merged``: values over the row (n) and the one that it points at (a). Every round doubles the way that is known.
    """
    now, found = stored(now, "pointers"), F.col("a.turn").isNotNull()
    while True:
        step = now.alias("n").join(now.alias("a"), (F.col("n.conv_id") == F.col("a.conv_id")) & (F.col(f"n.{pointer}") == F.col("a.turn")), "left")
        if step.where(found).isEmpty():
            return now
        now = stored(step.select("n.conv_id", "n.turn", *(F.when(found, v).otherwise(F.col(f"n.{c}")).alias(c) for c, v in merged.items())), "pointers")


def preorder(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, top, depth, left) of the messages of all threads with links.

    top is the first message of the thread, left the number of messages behind this one in its depth-first order.
    Each message points at the next one: its first reply, else the next reply to it or to the nearest message above
    that has one. Rows stay of one size however deep a thread is.
    """
    key = ["conv_id", "turn"]
    tops = _followed(links.select(*key, F.col("reply_to").alias("top"), F.lit(1).alias("depth")), "top",
                     top=F.col("a.top"), depth=F.col("n.depth") + F.col("a.depth"))
    cut = _ranged(links, "conv_id", "reply_to", "turn")
    group = ["conv_id", "reply_to", "part"]
    behind = cut.groupBy(*group).agg(F.min("turn").alias("first")).selectExpr(
        *group, "lead(first) OVER (PARTITION BY conv_id, reply_to ORDER BY part) AS behind")
    siblings = cut.selectExpr("*", "lead(turn) OVER (PARTITION BY conv_id, reply_to, part ORDER BY turn) AS beside").join(behind, group).select(
        *key, "reply_to", F.coalesce("beside", "behind").alias("next"))
    exits = _followed(siblings.select(*key, "next", F.when(F.col("next").isNull(), F.col("reply_to")).alias("up")), "up",
                      next=F.col("a.next"), up=F.col("a.up"))
    replies = links.groupBy("conv_id", "reply_to").agg(F.min("turn").alias("reply")).withColumnRenamed("reply_to", "turn")
    after = exits.join(replies, key, "full").select(*key, F.coalesce("reply", "next").alias("jump"))
    order = _followed(after.withColumn("left", F.col("jump").isNotNull().cast("long")), "jump",
                      jump=F.col("a.jump"), left=F.col("n.left") + F.col("a.left"))
    return order.join(tops.join(links, key), key, "left").select(
        *key, "reply_to", F.coalesce("top", "turn").alias("top"), F.coalesce("depth", F.lit(0)).alias("depth"), "left")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, depth, position, max_level, n_quoted and text (without quotes) of every message.

    position counts the messages of the conversation that come before in reply order; repeated (conv_id,
    turn) rows share it. Turns, without texts, are cut into ranges of that order at sampled bounds and counted
    inside each, and the sizes of the ranges before are added, so that no conversation or thread is a single
    group. Messages without a turn come first.
    """
    read = parsed(messages)
    known = preorder(stored(linked(read), "links")).alias("k")
    turns = messages.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).alias("m")
    placed = turns.join(known, (F.col("m.conv_id") == F.col("k.conv_id")) & (F.col("m.turn") == F.col("k.turn")), "left").select(
        F.col("m.conv_id").alias("c"), F.col("m.turn").alias("t"), "n", "reply_to", F.coalesce("top", "m.turn").alias("top"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce(-F.col("left"), F.lit(0)).alias("place"))
    cut = _ranged(placed, "c", "top", "place")
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    bases = cut.groupBy("c", "part").agg(F.sum("n").alias("size")).selectExpr(
        "c AS b", "part AS p", f"coalesce(sum(size) OVER (PARTITION BY c ORDER BY part {before} AS base")
    inside = cut.selectExpr("*", f"coalesce(sum(n) OVER (PARTITION BY c, part ORDER BY top, place {before} AS inside")
    order = inside.join(bases, F.col("c").eqNullSafe(F.col("b")) & F.col("part").eqNullSafe(F.col("p"))).select(
        "c", "t", "reply_to", "depth", (F.col("base") + F.col("inside")).cast("long").alias("position"))
    return read.join(order, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))).select(
        "conv_id", "turn", "role", "reply_to", "depth", "position", "max_level", "n_quoted", F.col("own").alias("text"))
