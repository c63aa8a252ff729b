"""Quotation linking: which passages of a message are quoted from which message, and the conversation without quotes.

Lines are read with their quote level (the number of ``>`` before the text). Neighbouring lines of one level, without
blank lines between, form a passage; it is normalised and hashed. Passages at level 0 are a message's own words; quoted
ones join the message that first said them, whole or as part of a paragraph, in the same conversation if it is there, else anywhere. The last own
conversation message quoted at level 1 is the parent of a reply. Arrays, joins and grouped minima of Spark only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import Scratch, hot_join

LEVEL = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"^\s*\S.* wrote:\s*$"  # the line by which mail programs introduce a quotation


def _normal(passage: Column) -> Column:
    return F.md5(F.lower(F.trim(F.regexp_replace(passage, r"\s+", " "))).cast("binary"))


def passages(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with ``passages``, an array of (level, body) in the order of the text, without blank ones and without
    the line "... wrote:" before a quotation. Null text counts as empty and has none."""
    line = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\r\n|\r|\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, LEVEL, 0), "[^>]", ""))
    body = lambda x: F.regexp_replace(x, LEVEL + " ?", "")
    out = messages.withColumn("_lines", F.transform(line, lambda x: F.struct(level(x).alias("level"), body(x).alias("body"), (F.trim(F.regexp_replace(body(x), r"\s+", " ")) == "").alias("blank"))))
    n = F.size("_lines")
    here, before = lambda i: F.element_at("_lines", i), lambda i: F.element_at("_lines", i - 1)
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, True).otherwise((here(i)["level"] != before(i)["level"]) | (here(i)["blank"] != before(i)["blank"])))
    out = out.withColumn("_starts", F.concat(begins, F.array(n + 1)))
    cut = F.transform(F.sequence(F.lit(1), F.size("_starts") - 1), lambda k: F.slice("_lines", F.element_at("_starts", k), F.element_at("_starts", k + 1) - F.element_at("_starts", k)))
    full = F.transform(cut, lambda p: F.struct(p[0]["level"].alias("level"), F.array_join(F.transform(p, lambda x: x["body"]), "\n").alias("body"), p[0]["blank"].alias("blank")))
    said = F.filter(full, lambda p: ~p["blank"])
    out = out.withColumn("_said", F.transform(said, lambda p: F.struct(p["level"].alias("level"), p["body"].alias("body"))))
    # the line that introduces a quotation goes with it; the same words before own text stay
    own = F.filter("_said", lambda p, i: ~((p["level"] == 0) & p["body"].rlike(ATTRIBUTION) & F.coalesce(F.get("_said", i + 1)["level"] > 0, F.lit(False))))
    return out.withColumn("passages", own).drop("_lines", "_starts", "_said")


def _threads(tmp: Scratch, per: DataFrame) -> DataFrame:
    """(conv_id, turn, anc, steps): the root of each message that has a ``parent_turn``, and its distance."""
    # root and depth by doubling: anc is the ancestor reached so far, steps its distance
    up = tmp.keep(per.where("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("anc"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("more")), "ancestors")
    while not up.where("more").isEmpty():
        far = up.select("conv_id", F.col("turn").alias("anc"), F.col("anc").alias("anc2"), F.col("steps").alias("steps2"))
        # only messages that have not reached their root go on
        nxt = hot_join(up.where("more").drop("more"), far, ["conv_id", "anc"]).select("conv_id", "turn", F.coalesce("anc2", "anc").alias("anc"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("anc2").isNotNull().alias("more"))
        nxt = tmp.keep(nxt.unionByName(up.where("not more")), "ancestors")
        tmp.drop(up)
        up = nxt
    return up.select("conv_id", "turn", "anc", "steps")


def link_quotes(messages: DataFrame, tmp: Scratch | None = None) -> DataFrame:
    """One row per row of ``messages(conv_id, turn, role, text, ...)``, without the quotes.

    clean_text: own passages, separated by a blank line; n_quotes: quoted passages of any level; n_linked: those whose
    origin is found, the first message of the conversation (of a smaller turn) or else the first of all other ones (by
    conv_id, turn) that holds the whole passage, as an own paragraph or as a run of lines of one; parent_turn: the largest
    turn of the conversation that a level-1 passage comes from; root_turn and reply_depth follow the parents, so that
    sorting by (conv_id, root_turn, turn) gives each thread with replies after their parents.
    Null text counts as empty. Rows that repeat a (conv_id, turn) are one message: their quotes count together, each row
    is returned. Rows without conv_id or turn link nothing. Extra columns are ignored; empty gives empty.
    """
    tmp = tmp or Scratch(messages.sparkSession)
    read = _read(messages, tmp, "role")
    one = _passage_rows(read, tmp)
    asked = one.where("conv_id is not null and turn is not null and level > 0")
    linked = _whole_origins(one, tmp).select("msg", "no", "here", "ot", F.lit(1).alias("linked"))
    found = asked.select("msg", "no", "conv_id", "turn", "level").join(linked, ["msg", "no"], "left")
    per = found.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.sum(F.coalesce("linked", F.lit(0))).alias("n_linked"),
        F.max(F.when(F.col("here") & (F.col("level") == 1), F.col("ot"))).alias("parent_turn"))
    per = tmp.keep(per, "quotes")
    up = _threads(tmp, per)
    out = hot_join(read, per, ["conv_id", "turn"])
    out = hot_join(out, up, ["conv_id", "turn"])
    clean = F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["body"]), "\n\n")
    return out.select("conv_id", "turn", "role", clean.alias("clean_text"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
                      "parent_turn", F.coalesce("anc", "turn").alias("root_turn"), F.coalesce("steps", F.lit(0)).cast("long").alias("reply_depth"))


def _read(messages: DataFrame, tmp: Scratch, *more: str) -> DataFrame:
    """The messages with their passages and a number for each row, kept: exploded at once, the passages would be cut again for every filter on them."""
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text", *[F.col(c).cast("string").alias(c) for c in more])
    return tmp.keep(passages(base.withColumn("msg", F.monotonically_increasing_id())).select("msg", "conv_id", "turn", *more, "passages"), "read")


def _passage_rows(read: DataFrame, tmp: Scratch) -> DataFrame:
    """(msg, conv_id, turn, no, level, hash, lines, k), kept."""
    one = read.select("msg", "conv_id", "turn", F.posexplode("passages").alias("no", "p"))
    return tmp.keep(one.select("msg", "conv_id", "turn", "no", F.col("p.level").alias("level"), _normal(F.col("p.body")).alias("hash"), F.split("p.body", "\n").alias("lines")).withColumn("k", F.size("lines")), "passages")


def quote_origins(messages: DataFrame, tmp: Scratch | None = None) -> DataFrame:
    """One row per quoted passage of ``messages(conv_id, turn, text, ...)``, with its origin and the reply order.

    conv_id, turn, passage_no (its place among the passages of the message), level, passage_hash, n_lines;
    n_lines_found: lines that the origin holds (n_lines, if it holds the whole passage); origin_conv_id, origin_turn;
    parent_turn, root_turn and reply_depth of the message. An origin holds a passage if it has it as an own paragraph, or
    as a run of lines of one: the first message of a smaller turn of the conversation, or else the first of the other
    conversations. If no message holds the whole passage, the lines are looked up one by one, and the message that is
    the origin of most of them is taken, one of the conversation before others. Rows without conv_id or turn link nothing.
    Null and empty texts have no passages; rows that repeat a (conv_id, turn) each give their passages. Extra columns are
    ignored; empty gives empty.
    """
    tmp = tmp or Scratch(messages.sparkSession)
    one = _passage_rows(_read(messages, tmp), tmp)
    found = _finder(one, tmp)
    quoted = one.where("conv_id is not null and turn is not null and level > 0")
    whole = _whole_origins(one, tmp, found)
    rest = quoted.where("k > 1").join(whole.select("msg", "no"), ["msg", "no"], "left_anti")
    parts = found(rest.select("msg", "no", "conv_id", "turn", F.explode(F.transform("lines", _normal)).alias("hash"), F.lit(1).alias("n")))
    parts = parts.groupBy("msg", "no", "here", "oc", "ot").agg(F.sum("n").cast("int").alias("n"))
    best = F.max(F.struct("here", "n", (-F.col("oc")).alias("c"), (-F.col("ot")).alias("t"))).alias("b")
    parts = parts.groupBy("msg", "no").agg(best).select("msg", "no", "b.here", (-F.col("b.c")).alias("oc"), (-F.col("b.t")).alias("ot"), "b.n")
    out = one.where("level > 0").drop("lines").join(whole.unionByName(parts), ["msg", "no"], "left")
    out = tmp.keep(out, "origins")
    per = tmp.keep(out.where("here and level = 1").groupBy("conv_id", "turn").agg(F.max("ot").alias("parent_turn")), "parents")
    out = hot_join(hot_join(out, per, ["conv_id", "turn"]), _threads(tmp, per), ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.col("no").alias("passage_no"), "level", F.col("hash").alias("passage_hash"), F.col("k").alias("n_lines"), F.coalesce("n", F.lit(0)).alias("n_lines_found"),
                      F.col("oc").alias("origin_conv_id"), F.col("ot").alias("origin_turn"), "parent_turn", F.coalesce("anc", "turn").alias("root_turn"), F.coalesce("steps", F.lit(0)).cast("long").alias("reply_depth"))


def _finder(one: DataFrame, tmp: Scratch) -> Callable[[DataFrame], DataFrame]:
    """A function that finds the origins of (msg, no, conv_id, turn, hash, n): here, oc, ot for those that have one.

    Units are the own paragraphs, their lines, and the runs of lines that some quoted passage may ask for.
    """
    known = F.expr("conv_id is not null and turn is not null")
    own, quoted = one.where(known & (F.col("level") == 0)), one.where(known & (F.col("level") > 0))
    # the runs of lines that are asked for: a line begins one if some quoted passage begins with it
    heads = quoted.where("k > 1").select(_normal(F.col("lines")[0]).alias("line"), F.col("k").alias("run")).distinct()
    line = own.select("msg", "conv_id", "turn", "no", "k", F.posexplode(F.transform("lines", _normal)).alias("at", "line"))
    asked = hot_join(line.where("k > 1"), heads, ["line"], "inner").where("at + run <= k").groupBy("msg", "no").agg(F.collect_list(F.struct("at", "run")).alias("runs"))
    runs = own.join(asked, ["msg", "no"]).select("conv_id", "turn", "lines", F.explode("runs").alias("r"))
    runs = runs.select("conv_id", "turn", _normal(F.array_join(F.slice("lines", F.col("r.at") + 1, F.col("r.run")), "\n")).alias("hash"))
    units = own.select("conv_id", "turn", "hash").unionByName(line.select("conv_id", "turn", F.col("line").alias("hash"))).unionByName(runs)
    said = tmp.keep(units.groupBy("conv_id", "hash").agg(F.min("turn").alias("said_turn")), "said")
    # the two first conversations of a unit: one of them is another one than the quoting message's
    first = said.groupBy("hash").agg(F.min(F.struct("conv_id", "said_turn")).alias("f1"))
    second = hot_join(said, first, ["hash"], "inner").where("conv_id <> f1.conv_id").groupBy("hash").agg(F.min(F.struct("conv_id", "said_turn")).alias("f2"))
    first = tmp.keep(hot_join(first, second, ["hash"]), "first")

    def found(asking: DataFrame) -> DataFrame:
        out = hot_join(hot_join(asking, said, ["conv_id", "hash"]), first, ["hash"])
        here = F.coalesce(F.col("said_turn") < F.col("turn"), F.lit(False))
        other = F.when(F.col("f1.conv_id") != F.col("conv_id"), F.col("f1")).otherwise(F.col("f2"))
        return out.select("msg", "no", here.alias("here"), F.when(here, F.col("conv_id")).otherwise(other["conv_id"]).alias("oc"), F.when(here, F.col("said_turn")).otherwise(other["said_turn"]).alias("ot"), "n").where("oc is not null")
    return found


def _whole_origins(one: DataFrame, tmp: Scratch, found: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The origins of the quoted passages that some message holds as a whole, kept."""
    quoted = one.where("conv_id is not null and turn is not null and level > 0")
    return tmp.keep((found or _finder(one, tmp))(quoted.select("msg", "no", "conv_id", "turn", "hash", F.col("k").alias("n"))), "whole")


def as_replies(conversations: DataFrame) -> DataFrame:
    """The turns of ``conversations`` as quoted replies, the form in which mail and forum messages arrive.

    A turn first quotes the first line of the turn before, below that line's own quotation of the turn before it, and
    then says its own text. Turns are met by number, so that a conversation of any length needs no ordered pass.
    """
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    line = t.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.substring_index("text", "\n", 1)).alias("line"))
    back = lambda k: line.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("line").alias(f"line{k}"))
    both = hot_join(hot_join(t, back(1), ["conv_id", "turn"]), back(2), ["conv_id", "turn"])
    mark = lambda c, m: F.when(F.trim(F.col(c)) != "", F.concat(F.lit(m), F.col(c)))
    return both.select("conv_id", "turn", "role", F.concat_ws("\n", F.when(F.trim(F.col("line1")) != "", F.concat(F.lit("Turn "), (F.col("turn") - 1).cast("string"), F.lit(" wrote:"))),
                                                              mark("line2", "> > "), mark("line1", "> "), F.col("text")).alias("text"))
