"""Chat formatting into budgeted windows of whole turns, with loss masks.

A turn costs its words plus a fixed overhead. What the budget leaves beside system turn and history is for a window's own turns. For
the system turn `system` is set aside, or the cost of the conversation's longest one if that is more. A turn of over half of what is
left is large and a span by itself. Prefix sums of the costs within a conversation deal the others: a new span begins at every large
turn, after it, and wherever floor(cost before the turn / stride) goes up. The stride is what is left less the cost of the longest turn
that is not large, so the turns of a span always fit, and a window is over the budget only where one turn is over what is left; if
nothing is left, every turn is a span. Spans are numbered without gaps. Every span becomes one window: the system turn whatever its
size (the last one before the span, wherever it stands), a limited history (the turns just before the span whose costs together fit in
`history`, from as many earlier spans as that takes), then the span's own turns. Loss covers the texts of assistants among the
own turns alone, so a repeated turn is masked and each target is trained once.

Texts are escaped: a backslash goes between the first characters of every control string, and before those already there, which
taking one away undoes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.llm.common import WORD

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY, SYSTEM, OVERHEAD = 2048, 256, 512, 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _header(role: Column) -> Column:
    """A role on one line: backslashes doubled, line ends written as \\n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role(header: Column) -> Column:
    lifted = F.replace(unescape(header), F.lit("\\\\"), F.lit("\\\x00"))
    return F.replace(F.replace(lifted, F.lit("\\n"), F.lit("\n")), F.lit("\\\x00"), F.lit("\\"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM) -> DataFrame:
    """Rows (conv_id, span, formatted, loss, n_repeated): loss is an array of [start, end) in code points of `formatted`,
    n_repeated the number of turns at its beginning that an earlier window has as its own.

    Takes conv_id, turn, role, text. A NULL text or role is empty; a NULL conv_id is a conversation of its own. Turns are
    ordered by turn, then role, then text, NULLs first; repeated rows are repeated turns. Further columns are not looked at.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    costed = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                          (F.regexp_count(text, F.lit(WORD)) + OVERHEAD).cast("long").alias("cost"))
    is_system, every = F.col("role") == "system", order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    large, cost = F.col("_large").cast("long"), F.col("cost")
    numbered = (costed.withColumn("n", F.row_number().over(order)).withColumn("_from", F.sum("cost").over(upto) - cost)
                .withColumn("_left", F.lit(budget - history) - F.greatest(F.lit(system), F.max(F.when(is_system, cost)).over(every)))
                .withColumn("_large", cost * 2 > F.col("_left"))
                .withColumn("_stride", F.greatest(F.lit(1), F.col("_left") - F.coalesce(
                    F.max(F.when(~F.col("_large"), cost)).over(every), F.lit(0))))
                .withColumn("_place", F.struct((F.sum(large).over(upto) * 2 - large).alias("run"), F.floor(F.col("_from") / F.col("_stride")).alias("k")))
                .withColumn("_new", F.coalesce(F.lag("_place").over(order) != F.col("_place"), F.lit(True)))
                .withColumn("span", F.sum(F.col("_new").cast("long")).over(upto) - 1)
                .withColumn("_told", F.when(is_system, F.struct("n", "role", "text")))
                .withColumn("_system", F.when(F.col("_new"), F.last("_told", True).over(upto))))
    # a turn costs OVERHEAD at least, so that history / OVERHEAD spans at most begin within `history` after it
    soon = Window.partitionBy("conv_id").orderBy("_from").rangeBetween(1, max(1, history))
    later = F.collect_list(F.when(F.col("_new"), F.col("span"))).over(soon) if history > 0 else F.array().cast("array<bigint>")
    own = F.array(F.struct(F.col("span"), F.lit(1).alias("own")))
    repeats = F.transform("_later", lambda k: F.struct(k.alias("span"), F.lit(0).alias("own")))
    dealt = numbered.withColumn("_later", later).withColumn("_to", F.explode(F.concat(own, repeats))).select(
        "conv_id", "_to.span", "_to.own", "n", "role", "text", F.when(F.col("_to.own") == 1, F.col("_system")).alias("sys"))
    turn = F.struct("n", "own", "role", "text")
    grouped = dealt.groupBy("conv_id", "span").agg(F.sort_array(F.collect_list(turn)).alias("own_turns"), F.max("sys").alias("sys"))
    listed = F.exists("own_turns", lambda t: t["n"] == F.col("sys.n"))
    lead = F.when(F.col("sys").isNotNull() & ~listed, F.array(F.struct(
        F.col("sys.n").alias("n"), F.lit(0).alias("own"), F.col("sys.role").alias("role"), F.col("sys.text").alias("text"))))
    whole = grouped.select("conv_id", "span", F.concat(F.coalesce(lead, F.array().cast(
        "array<struct<n:int,own:int,role:string,text:string>>")), "own_turns").alias("turns"))
    made = whole.withColumn("parts", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), _header(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
        ((t["own"] == 1) & (t["role"] == "assistant")).alias("loss"))))
    seen = F.aggregate(
        "parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["loss"], F.array_append(acc["loss"], F.struct(
                (acc["at"] + F.length(p["head"])).alias("start"),
                (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end")))).otherwise(acc["loss"]).alias("loss")),
        lambda acc: acc["loss"])
    return made.select(
        "conv_id", "span", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        seen.alias("loss"), F.size(F.filter("turns", lambda t: t["own"] == 0)).alias("n_repeated"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window, unescaped."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    bodies = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    return F.transform(bodies, lambda b: F.struct(
        _role(F.substring_index(F.substring(b, F.lit(len(START) + 1), F.length(b)), "\n", 1)).alias("role"),
        unescape(F.substring(b, F.instr(b, "\n") + 1, F.length(b))).alias("text")))


def digests(made: DataFrame) -> DataFrame:
    """One row per conversation, all read back from the windows' formatted text and loss spans."""
    back = made.select(
        "conv_id", "span", F.length("formatted").cast("long").alias("chars"),
        F.slice(read_turns(F.col("formatted")), F.col("n_repeated") + 1, F.greatest(F.lit(1), F.size(
            F.split("formatted", r"<\|im_end\|>\n", -1)))).alias("own"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "").alias("lossy"))
    lines = F.array_join(F.transform("own", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = back.select("conv_id", "span", "chars", F.size("own").alias("n"), lines.alias("lines"), "lossy")
    whole = per.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"),
        F.sort_array(F.collect_list(F.struct("span", "lines", "lossy"))).alias("all"))
    joined = lambda name: F.array_join(F.transform("all", lambda x: x[name]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("lines"), 256).alias("turns_sha256"),
        F.length(joined("lossy")).cast("long").alias("loss_chars"), F.sha2(joined("lossy"), 256).alias("loss_sha256"),
        "formatted_chars", "n_windows")
