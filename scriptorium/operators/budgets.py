"""Token budgets: which blocks of a document are shown, in what form, within a number of tokens.

Packing in an order up to the first misfit is a running sum over a window of the document's
blocks; packing that skips misfits is a fold over its array of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T


def pack_prefix(blocks: DataFrame, budget: Column | int, key: list[str] | str, order: list[Column | str], tokens: str = "tokens", truncation_left: int | None = rules.SECTION_TRUNCATION_LEFT, text: str = "text", heading_tokens: Column | None = None, least: int = 0) -> DataFrame:
    """Blocks in order while they fit; the first that does not is cut if more than `truncation_left` tokens are left.

    Gives the blocks shown with `shown` (their text) and `truncated`; all after the first misfit go.
    """
    keys = [key] if isinstance(key, str) else key
    limit = F.lit(budget) if isinstance(budget, int) else budget
    by_order = Window.partitionBy(*keys).orderBy(*order)
    out = blocks.withColumn("_sum", F.sum(tokens).over(by_order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_fits", F.col("_sum") <= limit)
    out = out.withColumn("_misfits", F.sum((~F.col("_fits")).cast("int")).over(by_order.rowsBetween(Window.unboundedPreceding, 0)))
    left = limit - (F.col("_sum") - F.col(tokens))
    shown = F.when(F.col("_fits") & (F.col("_misfits") == 0), F.col(text))
    if truncation_left is not None:
        room = F.greatest(left - (heading_tokens if heading_tokens is not None else F.lit(0)) - 4, F.lit(least))
        cut = T.truncate_to_tokens(F.col(text), room)
        shown = shown.when((F.col("_misfits") == 1) & ~F.col("_fits") & (left > truncation_left) & (cut != ""), cut)
    out = out.withColumn("shown", shown).withColumn("truncated", F.col("shown").isNotNull() & ~F.col("_fits"))
    return out.where(F.col("shown").isNotNull()).drop("_sum", "_fits", "_misfits")


def pack_skipping(blocks: DataFrame, budget: int, key: str, order: str = "pos", size: str = "bytes", most: int | None = None, largest: int | None = None) -> DataFrame:
    """(key, order) of the blocks that fit one after the other; a misfit is skipped and packing goes on.

    `most` bounds their number and `largest` the size of one.
    """
    arrays = blocks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("at"), F.col(size).cast("long").alias("size")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        ok = state["used"] + x["size"] <= budget
        if most is not None:
            ok = ok & (F.size(state["kept"]) < most)
        if largest is not None:
            ok = ok & (x["size"] <= largest)
        return F.struct(
            F.when(ok, state["used"] + x["size"]).otherwise(state["used"]).cast("long").alias("used"),
            F.when(ok, F.concat(state["kept"], F.array(x["at"]))).otherwise(state["kept"]).alias("kept"),
        )

    return arrays.select(key, F.explode(F.aggregate("items", start, step)["kept"]).alias(order))


def render(articles: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """Markdown of each article within one budget that its groups of blocks share in order.

    `articles` has key, group (order of the group), pos, text, tokens, stop (whether a misfit ends the group; a
    group of others shows nothing more). What a group leaves, the next may use: a fold over the blocks.
    """
    rows = articles.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("group", "pos", "tokens", "text"))).alias("blocks"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(-1).alias("closed"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, b: Column) -> Column:
        shut = state["closed"] == b["group"]
        ok = ~shut & (b["tokens"] <= state["left"])
        return F.struct(
            F.when(ok, state["left"] - b["tokens"]).otherwise(state["left"]).cast("long").alias("left"),
            F.when(~ok, b["group"]).otherwise(state["closed"]).cast("int").alias("closed"),
            F.when(ok, F.concat(state["out"], F.array(b["text"]))).otherwise(state["out"]).alias("out"),
        )

    folded = rows.select(key, F.aggregate("blocks", start, step).alias("x"), F.size("blocks").alias("total"))
    return folded.select(key, F.array_join("x.out", "\n\n").alias("markdown"), (F.lit(budget) - F.col("x.left")).alias("tokens"), (F.size("x.out") < F.col("total")).alias("truncated"))
