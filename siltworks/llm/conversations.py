"""Problem 4: conversations from message rows.

Method: conversations without an identifier are connected components over reply links (parent ids) and quote links (a tool
result quotes the id of a call), found by alternating large-star and small-star joins; then all conversations, with or without
an identifier of their own, are put in order and checked by the same rules (`assemble`).

Order and check: conversations of up to `SLICE` rows are sorted together by one shuffle and worked through one after another
in their task. Longer ones are never gathered: their order comes from list ranking by pointer doubling, in joins on
messages, and turns are checked in slices of `SLICE` positions and then between slices. Both ways give the same rows.

Rows with a null id are no messages. Rows delivered twice count once; a copy with content is preferred, then the latest
one. Roles are folded to user, assistant, system and tool; a role that is none of these breaks a conversation that is
ordered by rounds and counts for nothing in one that is ordered by links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siltworks.runtime import durable, require, table

SLICE = 1024
#: Rows of names up to which a list of conversations is broadcast; longer ones are joined by shuffles.
BROADCAST_ROWS = 50_000
#: Spellings of the four roles.
ROLES = {"user": ("user", "human", "prompter", "customer"), "assistant": ("assistant", "gpt", "bot", "ai", "model", "chatbot"), "system": ("system", "developer"), "tool": ("tool", "toolresult", "function", "functionresult", "toolresponse", "functionresponse", "observation")}
#: Characters that show nothing.
BLANK = r"[\s\u0000- \u0085 ­͏؜ᅟᅠ ឴឵᠋-᠎ -‏ -  -⁯⠀　ㅤ︀-️﻿ﾠ]"


def role_of(c: Column) -> Column:
    flat = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z]", "")
    return reduce(lambda e, r: e.when(flat.isin(*ROLES[r]), F.lit(r)), ROLES, F.when(F.lit(False), F.lit(""))).otherwise(F.lit("other"))


def has_content(c: Column) -> Column:
    return F.coalesce(c.rlike(BLANK.replace("[", "[^", 1)), F.lit(False))


def session_of(c: Column) -> Column:
    s = F.regexp_replace(F.trim(c), r"(?i)\.jsonl$", "")
    return F.when(F.length(s) > 0, s)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b); the component is its least node.

    Alternating stars: large-star joins all larger neighbours of a node to its least neighbour, small-star the smaller
    ones and the node itself. Least neighbours are aggregates, joined back; no neighbourhood is gathered. Each round is
    written to the shared folder. It ends when a round changes nothing; more rounds than max_rounds are an error.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cur = durable(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = durable(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        cur = durable(small)
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if last == now:
            break
        last = now
    else:
        raise RuntimeError(f"components: no end after {max_rounds} rounds")
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def rank(links: DataFrame, longest: int) -> DataFrame:
    """(conv, node, pos) of lists given as (conv, node, prev), prev null at the head; pos from 1. Nodes that no head leads to (cycles) have no row."""
    cur = durable(links.select("conv", "node", F.col("prev").alias("up"), F.lit(1).cast("bigint").alias("pos")))
    for _ in range(max(1, longest).bit_length()):
        if not cur.filter(F.col("up").isNotNull()).limit(1).count():
            break
        hop = cur.select("conv", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("pos").alias("pos2"))
        cur = durable(cur.join(hop, ["conv", "up"], "left").select("conv", "node", F.col("up2").alias("up"), (F.col("pos") + F.coalesce("pos2", F.lit(0))).alias("pos")))
    return cur.filter(F.col("up").isNull()).drop("up")


def rows_of(rows: DataFrame) -> DataFrame:
    """(session_id, id, parent, role, round, has, late) of each row with an id: what order and check need, without the content."""
    require(rows, "id", "session_id", "round", "role", "parentid", "content")
    late = F.unix_micros(F.col("ingested_at").cast("timestamp")) if "ingested_at" in rows.columns else F.lit(None).cast("bigint")
    parent = F.when(F.length(F.trim("parentid")) > 0, F.trim("parentid"))
    return rows.filter(F.col("id").isNotNull()).select(session_of(F.col("session_id")).alias("session_id"), "id", parent.alias("parent"), role_of(F.col("role")).alias("role"), F.col("round").cast("double").alias("round"), has_content(F.col("content")).alias("has"), late.alias("late"))


def messages(rows: DataFrame) -> DataFrame:
    """One row for each conv and id of rows_of: the copy that counts, and whether copies differ in their parent."""
    g = rows.groupBy("conv", "id").agg(F.max(F.struct("has", "late", "role", "round")).alias("r"), F.min("parent").alias("parent"), F.max("parent").alias("_p2"), F.count("parent").alias("_np"), F.count("*").alias("_n"))
    torn = (F.coalesce(F.col("parent") != F.col("_p2"), F.lit(False))) | ((F.col("_np") > 0) & (F.col("_np") < F.col("_n")))
    return g.select("conv", "id", "parent", torn.alias("torn"), "r.role", "r.round", "r.has")


def answered(ordered: DataFrame) -> DataFrame:
    """conv of each conversation whose users all have content and an answer; ordered: (conv, pos, role, has)."""
    turns = ordered.filter((F.col("role") == "user") | ((F.col("role") == "assistant") & F.col("has"))).withColumn("u", F.col("role") == "user").withColumn("slice", F.floor(F.col("pos") / SLICE))
    w = W.partitionBy("conv", "slice").orderBy("pos")
    t = turns.withColumn("twice", F.col("u") & F.coalesce(F.lag("u").over(w), F.lit(False)))
    s = t.groupBy("conv", "slice").agg(F.max("twice").alias("twice"), F.max(F.col("u") & ~F.col("has")).alias("empty"), F.max("u").alias("any"), F.min_by("u", "pos").alias("first"), F.max_by("u", "pos").alias("last"))
    w = W.partitionBy("conv").orderBy("slice")
    s = s.withColumn("twice", F.col("twice") | (F.col("first") & F.coalesce(F.lag("last").over(w), F.lit(False))))
    g = s.groupBy("conv").agg(F.max("twice").alias("twice"), F.max("empty").alias("empty"), F.max("any").alias("any"), F.max_by("last", "slice").alias("last"))
    return g.filter(F.col("any") & ~F.col("twice") & ~F.col("empty") & ~F.col("last")).select("conv")


def by_links(msgs: DataFrame) -> DataFrame:
    """(conv, id, pos, role, has) of the conversations with links that form one path. msgs: (conv, id, parent, torn, role, has)."""
    child = msgs.filter(F.col("parent").isNotNull())
    there = child.join(msgs.select("conv", F.col("id").alias("parent")), ["conv", "parent"], "left_semi")
    ok = there.groupBy("conv").agg(F.count("*").alias("_there"))
    kids = child.groupBy("conv", "parent").agg(F.count("*").alias("k")).groupBy("conv").agg(F.max("k").alias("most"))
    g = msgs.groupBy("conv").agg(F.count("*").alias("n"), F.count("parent").alias("np"), F.max("torn").alias("torn"))
    cand = g.join(kids, "conv").join(ok, "conv").filter((F.col("np") == F.col("n") - 1) & (F.col("_there") == F.col("np")) & (F.col("most") == 1) & ~F.col("torn")).select("conv", "n")
    kept = durable(msgs.join(cand, "conv"))
    longest = kept.agg(F.max("n")).first()[0] or 0
    pos = rank(kept.select("conv", F.col("id").alias("node"), F.col("parent").alias("prev")), longest)
    # what one head doesn't lead to is a cycle
    whole = pos.groupBy("conv").agg(F.count("*").alias("n")).join(cand, ["conv", "n"], "left_semi").select("conv")
    return kept.join(pos.withColumnRenamed("node", "id"), ["conv", "id"]).join(whole, "conv", "left_semi").select("conv", "id", "pos", "role", "has")


def by_rounds(msgs: DataFrame) -> DataFrame:
    """(conv, id, pos, role, has) of the conversations without links whose rounds are whole. msgs: (conv, id, role, round, has)."""
    r = F.col("round")
    user, bot, system = (F.col("role") == x for x in ("user", "assistant", "system"))
    good = (r.isNotNull() & (r == F.floor(r)) & ((system & (r == 0)) | ((user | bot) & (r >= 1))))
    per = msgs.withColumn("good", F.coalesce(good, F.lit(False))).groupBy("conv", "round").agg(F.min("good").alias("good"), F.sum(user.cast("int")).alias("users"), F.sum(bot.cast("int")).alias("bots"), F.sum(system.cast("int")).alias("systems"))
    fine = F.col("good") & F.when(r == 0, F.col("systems") <= 1).otherwise((F.col("users") == 1) & (F.col("bots") == 1))
    g = per.groupBy("conv").agg(F.min(F.coalesce(fine, F.lit(False))).alias("fine"), F.max("round").alias("top"), F.sum((r >= 1).cast("int")).alias("rounds"), F.sum("systems").alias("systems"))
    kept = g.filter(F.col("fine") & (F.col("rounds") > 0) & (F.col("top") == F.col("rounds"))).select("conv", "systems")
    place = F.when(system, F.lit(1)).otherwise(F.col("systems") + (r - 1) * 2 + F.when(user, 1).otherwise(2)).cast("bigint")
    return msgs.join(kept, "conv").select("conv", "id", place.alias("pos"), "role", "has")


def assemble_long(rows: DataFrame) -> DataFrame:
    """(conv, pos, id, role) of every message of each conversation that is kept; joins and aggregations on messages only."""
    msgs = durable(messages(rows))
    linked = msgs.filter(F.col("parent").isNotNull() | F.col("torn")).select("conv").distinct()
    a, b = by_links(msgs.join(linked, "conv", "left_semi")), by_rounds(msgs.join(linked, "conv", "left_anti"))
    ordered = durable(a.unionByName(b))
    return ordered.join(answered(ordered), "conv", "left_semi").select("conv", "pos", "id", "role")


def in_order(own: list[tuple]) -> list[tuple[str, str]]:
    """(id, role) of a conversation's messages in order, or nothing if it isn't kept. own: (id, parent, role, round, has, late) of its rows."""
    parents: dict[str, str | None] = {}
    best: dict[str, tuple] = {}
    for i, parent, role, rnd, has, late in own:
        this = (has, late is not None, late or 0, role, rnd is not None, rnd if rnd is not None else 0.0)
        if i not in best:
            parents[i], best[i] = parent, this
            continue
        if parents[i] != parent:
            return []
        if this > best[i]:
            best[i] = this
    if any(parents.values()):
        after: dict[str, str] = {}
        at = None
        for i, p in parents.items():
            if p is None:
                if at is not None:
                    return []
                at = i
            elif p not in parents or p in after:
                return []
            else:
                after[p] = i
        order = []
        while at is not None:
            order.append(at)
            at = after.get(at)
        if len(order) != len(parents):
            return []
    else:
        turns: dict[float, dict[str, str]] = {}
        for i, (_, _, _, role, known, rnd) in best.items():
            if not known or role not in (("system",) if rnd == 0 else ("user", "assistant")) or role in turns.setdefault(rnd, {}):
                return []
            turns[rnd][role] = i
        first = turns.pop(0.0, {})
        if not turns or any(float(k) not in turns or len(turns[k]) != 2 for k in range(1, len(turns) + 1)):
            return []
        order = [*first.values(), *(turns[k][r] for k in range(1, len(turns) + 1) for r in ("user", "assistant"))]
    asked = waiting = False
    for i in order:
        has, role = best[i][0], best[i][3]
        if role == "user":
            if waiting or not has:
                return []
            asked = waiting = True
        elif role == "assistant" and has:
            waiting = False
    return [(i, best[i][3]) for i in order] if asked and not waiting else []


def assemble_short(rows: DataFrame) -> DataFrame:
    """assemble_long for conversations that fit a task: one shuffle by conversation, then one pass over the sorted rows."""
    names = ("id", "parent", "role", "round", "has", "late")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own = None, []
        out: list[tuple] = []

        def close() -> None:
            out.extend((conv, k, i, role) for k, (i, role) in enumerate(in_order(own), 1))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["conv", "pos", "id", "role"])

        for b in batches:
            for c, *r in zip(*[x.to_pylist() for x in b.columns]):
                if c != conv:
                    if own:
                        close()
                    conv, own = c, []
                own.append(r)
            yield batch()
            out.clear()
        if own:
            close()
        yield batch()

    # by an expression of its own: a repartition by the key of a join before it would be dropped, and that join's may be read by mapper
    return rows.select("conv", *names).repartition(F.xxhash64("conv")).sortWithinPartitions("conv").mapInArrow(run, "conv string, pos bigint, id string, role string")


def assemble(rows: DataFrame, most: int = SLICE) -> DataFrame:
    """(conv, pos, id, role) of every message of each conversation that is kept. rows: rows_of with a column conv, not null.

    Conversations of more than `most` rows go the distributed way, all others through assemble_short; which rows come out doesn't depend on it.
    """
    long = durable(rows.groupBy("conv").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("conv"))
    n = long.count()
    if not n:
        return assemble_short(rows)
    long = F.broadcast(long) if n <= BROADCAST_ROWS else long
    return assemble_short(rows.join(long, "conv", "left_anti")).unionByName(assemble_long(rows.join(long, "conv", "left_semi")))


def named(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """rows_of with `conv` and `lost`: rows without a session get the conversation that their links lead to.

    calls: (id, call, answers) of the ids of tool calls that a message makes or quotes. Links are those with a row without a session at one
    end at least; a component over them with messages of one session belongs to it, one without any is a conversation of its own,
    named by its least id, and one with several sessions can't be told: its lost rows stay out.
    """
    lost = durable(rows.filter(F.col("session_id").isNull()))
    ids = lost.select("id").distinct()
    up = lost.filter(F.col("parent").isNotNull()).select(F.col("id").alias("a"), F.col("parent").alias("b"))
    down = rows.filter(F.col("session_id").isNotNull() & F.col("parent").isNotNull()).join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").select(F.col("id").alias("a"), F.col("parent").alias("b"))
    made = calls.filter(~F.col("answers")).select("call", F.col("id").alias("b"))
    quoted = calls.filter("answers").select("call", F.col("id").alias("a")).join(made, "call").filter("a != b")
    quotes = quoted.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").select("a", "b").union(quoted.join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))
    comp = durable(components(durable(up.union(down).union(quotes).distinct())).withColumnRenamed("node", "id"))
    homes = rows.filter(F.col("session_id").isNotNull()).join(comp, "id").groupBy("component").agg(F.min("session_id").alias("lo"), F.max("session_id").alias("hi"))
    home = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNull(), F.coalesce("component", "id"))
    found = lost.join(comp, "id", "left").join(homes, "component", "left").withColumn("conv", home).filter(F.col("conv").isNotNull()).drop("component", "lo", "hi").withColumn("lost", F.lit(True))
    return rows.filter(F.col("session_id").isNotNull()).withColumn("conv", F.col("session_id")).withColumn("lost", F.lit(False)).unionByName(found)


def found_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of the rows that name their session; rows without one belong to none."""
    rows = rows_of(table(spark, sf_dir, "messagedict")).filter(F.col("session_id").isNotNull()).withColumnRenamed("session_id", "conv")
    return assemble(rows).select(F.col("conv").alias("session_id"), "pos", "id")


def recovered_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that rows without a session belong to by their reply and quote links, whole and in order, kept by the same rules."""
    src = table(spark, sf_dir, "messagedict")
    made = src.select("id", F.explode(F.col("tool_calls.id")).alias("call"), F.lit(False).alias("answers"))
    quoted = src.select("id", F.explode(F.col("tool_results.toolcallid")).alias("call"), F.lit(True).alias("answers"))
    rows = named(rows_of(src), made.union(quoted).filter(F.col("id").isNotNull() & (F.length("call") > 0)).distinct())
    touched = durable(rows.filter("lost").select("conv").distinct())
    rows = durable(rows.join(touched, "conv", "left_semi"))
    lost = rows.groupBy("conv", "id").agg(F.max("lost").alias("was_lost"))
    return assemble(rows).join(lost, ["conv", "id"]).select(F.col("conv").alias("conversation"), "pos", "id", "role", "was_lost")
