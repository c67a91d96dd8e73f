"""Chat formatting: snapshots that prefix a longer conversation collapse into it; what remains is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n, h1, h2: the 128-bit hash of the first pos turns, rolled on from turn to turn.

    Each turn is hashed with its position, and the hashes are combined by exclusive or, so a running
    aggregate rolls them without gathering a conversation. Nulls differ from empty strings.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    told = [F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in (F.col("role"), F.col("text"))]
    w = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = turns.where("conv_id is not null").select("conv_id", F.row_number().over(by).alias("pos"), "turn", "role", "text")
    hashed = numbered.select("conv_id", "pos", F.xxhash64(F.lit(11), "pos", *told).alias("a"), F.xxhash64(F.lit(29), "pos", *told, F.lit(7)).alias("b"))
    order = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.select("conv_id", "pos", F.expr("bit_xor(a)").over(order).alias("h1"), F.expr("bit_xor(b)").over(order).alias("h2"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n and h1, h2 of the conversations that no longer one starts with; of equal ones the smallest id."""
    p = prefix_hashes(turns)
    whole = p.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = p.where("pos < n").select("pos", "h1", "h2").distinct()
    return whole.join(inner, (whole["n"] == inner["pos"]) & (whole["h1"] == inner["h1"]) & (whole["h2"] == inner["h2"]), "left_anti")


def render(role, text) -> F.Column:
    """One turn as <|im_start|>role, text, <|im_end|>; such marks inside a text are broken by a zero-width space."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("<|​im_"))
    return F.concat(F.lit("<|im_start|>"), safe(role), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, rendered for each maximal conversation of conversations(conv_id, turn, role, text).

    A logged conversation whose turns (role and text, in order of turn, then role and text on ties) are a
    proper prefix of another's goes; of equal ones the smallest conv_id stays, and copies says how many
    there were. Rows without conv_id belong to no conversation and are left out; null roles and texts are
    values of their own and render as empty. Conversations compare by 128-bit prefix hashes: whole ones
    are grouped and proper prefixes made distinct before the anti-join, so a hot first turn is one row.
    The texts move once, for the conversations that stay.
    """
    keep = maximal(conversations).select("conv_id", F.col("n").alias("n_turns"), "copies")
    t = conversations.select("conv_id", "turn", "role", "text").join(keep, "conv_id")
    gathered = t.groupBy("conv_id", "n_turns", "copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return gathered.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("copies").cast("long").alias("copies"), F.array_join(F.transform("t", lambda x: render(x["role"], x["text"])), "").alias("rendered"))
