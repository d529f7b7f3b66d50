"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is the prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import repeated, staged

#: Turns of a part that one record holds; a longer part goes on in the pair's next record.
RECORD_TURNS = 512
SIDES = ["pair_id", "side", "position", "role", "text"]


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))


def rendered(role: Column, text: Column) -> Column:
    """A turn in the chat template; a null role or text counts as empty."""
    return F.concat(header(role), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def placed_turns(turns: DataFrame, bucket_turns: int = 1024) -> DataFrame:
    """(conv_id, position, role, text): turns by number, then role and text, nulls first, at positions from 0.

    Equal turns that repeat take a position each.  A conversation is ranked in stretches of turn numbers, so that however
    long it is, no task sorts all of it.  Turns of a null conversation aren't in the result.
    """
    folded = turns.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    folded = folded.withColumn("stretch", F.floor(F.col("turn") / bucket_turns))
    lengths = folded.groupBy("conv_id", "stretch").agg(F.sum("n").alias("length"))
    before = F.sum("length").over(Window.partitionBy("conv_id").orderBy(F.col("stretch").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    starts = lengths.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), F.coalesce(before, F.lit(0)).alias("start"))
    order = Window.partitionBy("conv_id", "stretch").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    ranked = folded.withColumn("up_to", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = ranked.join(starts, (F.col("conv_id") == F.col("c")) & F.col("stretch").eqNullSafe(F.col("s")))
    each = repeated(joined, F.col("n"), "i")
    return each.select("conv_id", (F.col("start") + F.col("up_to") - F.col("n") + F.col("i")).cast("long").alias("position"), "role", "text")


def swapped_answers(placed: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Sides of pairs: each conversation is chosen over itself with its last answer from its partner, 2k from 2k + 1 and back.

    ``placed``: (conv_id, position, role, text).  The rejected side ends with that answer.  A conversation that has none, or
    whose partner has none, is a ``single`` side.
    """
    last = placed.filter(F.col("role") == trained_role).groupBy("conv_id").agg(F.max(F.struct("position", "role", "text")).alias("own"))
    partner = F.col("conv_id").bitwiseXOR(F.lit(1))
    other = last.select(partner.alias("conv_id"), F.col("own").alias("other"))
    pairs = last.select("conv_id", F.col("own.position").alias("at")).join(other, "conv_id")
    known = placed.join(pairs.select("conv_id", "at"), "conv_id", "left")
    side = F.when(F.col("at").isNull(), F.array(F.lit("single"))).when(F.col("position") < F.col("at"), F.array(F.lit("chosen"), F.lit("rejected"))).otherwise(F.array(F.lit("chosen")))
    sides = known.select(F.col("conv_id").alias("pair_id"), F.explode(side).alias("side"), "position", "role", "text")
    answers = pairs.select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), F.col("at").alias("position"), F.col("other.role").alias("role"), F.col("other.text").alias("text"))
    return sides.unionByName(answers)


def format_preferences(sides: DataFrame, *, trained_role: str = "assistant") -> DataFrame:
    """One row per turn kept: pair_id, part, position (in its part, from 0), role, text, loss.

    ``sides`` (pair_id, side, position, role, text): the turns of chosen, rejected and single conversations at positions
    from 0.  Part ``prompt`` holds the turns both sides begin with, once; ``chosen`` and ``rejected`` hold what follows in
    each.  ``loss`` is true for a completion's turns of ``trained_role`` and false elsewhere.  A pair with one side only is
    all part ``single``, without loss.  Roles and texts are compared with nulls equal.  Rows are turns, so that a
    conversation of any length is formatted without being gathered.
    """
    told = [F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.isnull("role"), F.isnull("text")]
    digest = F.struct(F.xxhash64(*told), F.xxhash64(F.lit(7), *told))
    turn = lambda side: F.max(F.when(F.col("side") == side, digest)).alias(side)
    # Per pair and position the two turns meet, as hashes of 128 bits; the first position where they differ ends the prompt.
    met = sides.groupBy("pair_id", "position").agg(turn("chosen"), turn("rejected"))
    same = F.col("chosen").eqNullSafe(F.col("rejected"))
    ends = met.groupBy("pair_id").agg(F.min(F.when(~same, F.col("position"))).alias("fork"), F.max(F.col("position") + 1).alias("length"), F.max(F.col("chosen").isNotNull()).alias("has_c"), F.max(F.col("rejected").isNotNull()).alias("has_r"))
    ends = ends.select("pair_id", F.coalesce("fork", "length").alias("fork"), (F.col("has_c") & F.col("has_r")).alias("paired"))
    joined = sides.join(ends, "pair_id")
    is_prompt = F.col("paired") & (F.col("position") < F.col("fork"))
    what = F.when(~F.col("paired"), "single").when(is_prompt, "prompt").otherwise(F.col("side"))
    kept = joined.filter(~is_prompt | (F.col("side") == "chosen"))
    position = F.when(F.col("paired") & ~is_prompt, F.col("position") - F.col("fork")).otherwise(F.col("position"))
    return kept.select("pair_id", what.alias("part"), position.alias("position"), "role", "text", (F.col("paired") & ~is_prompt & F.coalesce(F.col("role") == trained_role, F.lit(False))).alias("loss"))


def preference_records(rows: DataFrame, record_turns: int = RECORD_TURNS) -> DataFrame:
    """Records of ``format_preferences``: pair_id, record, prompt, chosen, rejected, single, chosen_loss, rejected_loss.

    The prompt is rendered once, as one string; so are the completions.  The masks list the characters of a completion to
    train on, as ``from-to`` (excluded) joined by commas: the texts of trained turns with their end marks.  A part that a
    record lacks is null.  A record holds at most ``record_turns`` turns of each part; longer parts go on in the next record
    of the pair, so no task gathers more.
    """
    cut = rows.withColumn("record", F.floor(F.col("position") / record_turns).cast("long"))
    content = F.struct("part", "position", rendered(F.col("role"), F.col("text")).alias("content"), F.length(header(F.col("role"))).alias("head"), "loss")
    gathered = cut.groupBy("pair_id", "record").agg(F.array_sort(F.collect_list(content)).alias("turns"))

    def of(part: str) -> Column:
        return F.filter("turns", lambda x: x["part"] == part)

    def whole(part: str) -> Column:
        return F.when(F.size(of(part)) > 0, F.array_join(F.transform(of(part), lambda x: x["content"]), "")).alias(part)

    def mask(part: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

        def step(state: Column, x: Column) -> Column:
            end = state["at"] + F.length(x["content"])
            span = F.concat_ws("-", (state["at"] + x["head"]).cast("string"), end.cast("string"))
            return F.struct(end.alias("at"), F.when(x["loss"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

        return F.when(F.size(of(part)) > 0, F.aggregate(of(part), start, step, lambda state: F.array_join(state["spans"], ","))).alias(f"{part}_loss")

    return gathered.select("pair_id", "record", *map(whole, ("prompt", "chosen", "rejected", "single")), mask("chosen"), mask("rejected"))


def preference_data(turns: DataFrame, *, trained_role: str = "assistant", record_turns: int = RECORD_TURNS) -> DataFrame:
    """``preference_records`` of all conversations (conv_id, turn, role, text), paired by ``swapped_answers``.

    A turn of a null conversation is a ``single`` record of its own, of a null pair.  Repeated turns each count.  An empty
    table gives an empty table.  Other columns are not read.
    """
    base = turns.select("conv_id", "turn", "role", "text")
    placed = staged(placed_turns(base), "chat-turns")
    records = preference_records(format_preferences(swapped_answers(placed, trained_role), trained_role=trained_role), record_turns)
    text = F.lit(None).cast("string")
    stray = base.filter("conv_id is null").select(F.lit(None).cast("long").alias("pair_id"), F.lit(0).cast("long").alias("record"), *[text.alias(c) for c in ("prompt", "chosen", "rejected")], rendered(F.col("role"), F.col("text")).alias("single"), text.alias("chosen_loss"), text.alias("rejected_loss"))
    return records.unionByName(stray)
