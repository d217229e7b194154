"""Chat formatting in budgeted, turn-aligned windows, with DataFrame functions only.

Prefix sums of turn tokens deal a conversation's turns to windows. A stride is
what the system turn leaves of the ``budget``: turns that lie within one stride
share a window, a turn that crosses into the next has its own. The system turn
is the first with that role, wherever it stands; each window after its own
opens with it, then repeats up to ``history`` turns of the window before, the
nearest first and as far as the budget goes, then has its new turns. The loss
covers the texts of new assistant turns, so each target is learned once.

So a window's tokens stay within the budget. Turns are never cut: one that
exceeds the budget along with the system turn gets a window without history,
and isn't repeated. Only windows are gathered, not conversations.

A text is escaped so that no control string can stand in it: a backslash is
doubled and ``<|`` becomes ``<\\|``; ``unescaped`` undoes both.

Null texts and roles count as empty. Turns are ordered by turn, then role, then
text, so ties and repeated rows have a fixed order and each row stays a turn.
Rows without conv_id are one conversation. No rows give no windows; further
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, BODY, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
BUDGET, HISTORY, CHARS_PER_TOKEN = 1024, 2, 4


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, chars_per_token: int = CHARS_PER_TOKEN) -> DataFrame:
    """conv_id, window_id, text, turns and loss of each window.

    ``turns`` lists (start, length, repeated) of each formatted turn in the text,
    ``loss`` the (start, length) of each target; both count code points from 0.
    """
    rows = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(BODY))
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).alias("at"),
        (F.col("role") == "system").alias("is_system"),
        (F.col("role") == "assistant").alias("is_target"),
        F.concat(head, escaped(F.col("text")), F.lit(END)).alias("piece"),
        F.length(head).alias("head_length"),
    )
    by_at = Window.partitionBy("conv_id").orderBy("at")
    before = by_at.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("opening", F.col("is_system") & (F.coalesce(F.sum(F.col("is_system").cast("long")).over(before), F.lit(0)) == 0))
    size = F.ceil(F.length("piece") / chars_per_token)
    rows = rows.withColumn("tokens", F.when(F.col("opening"), 0).otherwise(size)).withColumn("system", F.coalesce(F.max(F.when(F.col("opening"), size)).over(whole), F.lit(0)))
    rows = rows.withColumn("left", F.greatest(F.lit(budget) - F.col("system"), F.lit(1))).withColumn("from", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    bucket, until = F.floor(F.col("from") / F.col("left")), F.floor((F.col("from") + F.col("tokens") - 1) / F.col("left"))
    rows = rows.withColumn("deal", F.struct(bucket.alias("bucket"), F.when(until > bucket, F.col("at")).otherwise(0).alias("alone")))
    # The system turn joins the turn after it.
    rows = rows.withColumn("deal", F.when(F.col("opening"), F.coalesce(F.lead("deal").over(by_at), F.lag("deal").over(by_at), F.col("deal"))).otherwise(F.col("deal")))
    rows = rows.withColumn("new", F.when(F.col("deal") == F.lag("deal").over(by_at), 0).otherwise(1))
    rows = rows.withColumn("span", F.sum("new").over(by_at.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rows = rows.withColumn("last", F.max("span").over(whole))
    in_span = Window.partitionBy("conv_id", "span").orderBy("at")
    rows = rows.withColumn("own", F.sum("tokens").over(in_span.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("rest", F.sum("tokens").over(in_span.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    later = [F.lead(F.struct("span", "own"), k).over(by_at) for k in range(1, history + 1)]
    follows = F.coalesce(*[F.when(x.span != F.col("span"), x) for x in later]) if history else F.lit(None).cast("struct<span:bigint,own:bigint>")
    rows = rows.withColumn("follows", follows)
    fits = F.col("system") + F.col("rest") + F.col("follows.own") <= budget
    rows = rows.withColumn("after", F.when(fits, F.col("follows.span")).otherwise(-1))
    # Each turn's windows: its own, and those that repeat it.
    repeats = F.when(F.col("opening"), F.when(F.col("last") > F.col("span"), F.sequence(F.col("span") + 1, F.col("last")))).when(F.col("after") >= 0, F.array("after"))
    own = F.array(F.struct(F.col("span").alias("window_id"), F.lit(False).alias("repeated")))
    again = F.transform(F.coalesce(repeats, F.array().cast("array<bigint>")), lambda w: F.struct(w.alias("window_id"), F.lit(True).alias("repeated")))
    placed = rows.select("conv_id", "opening", "at", "is_target", "piece", "head_length", F.explode(F.concat(own, again)).alias("place"))
    at = F.when(F.col("opening") & F.col("place.repeated"), 0).otherwise(F.col("at")).alias("at")
    placed = placed.select("conv_id", at, "is_target", "piece", "head_length", F.col("place.window_id").alias("window_id"), F.col("place.repeated").alias("repeated"))
    inside = Window.partitionBy("conv_id", "window_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(inside), F.lit(0)))
    part = F.struct("at", "piece", "head_length", "is_target", "repeated", "start")
    grouped = placed.groupBy("conv_id", "window_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    target = F.filter("p", lambda x: x.is_target & ~x.repeated)
    return grouped.select(
        "conv_id",
        "window_id",
        F.array_join(F.transform("p", lambda x: x.piece), "").alias("text"),
        F.transform("p", lambda x: F.struct(x.start.alias("start"), F.length(x.piece).cast("long").alias("length"), x.repeated.alias("repeated"))).alias("turns"),
        F.transform(target, lambda x: F.struct((x.start + x.head_length).alias("start"), (F.length(x.piece) - x.head_length - len(END)).cast("long").alias("length"))).alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Per conversation, from formatted windows alone: n_turns, turns (role, \\n, text, \\n each), loss_text, formatted_chars."""

    def cut(text: Column, at: Column) -> Column:
        return text.substr((at.start + 1).cast("int"), at.length.cast("int"))

    def plain(piece: Column) -> Column:
        body = F.substring_index(piece, END, 1)
        role = F.substring_index(F.substr(body, F.lit(len(START) + 1)), BODY, 1)
        return F.concat(unescaped(role), F.lit("\n"), unescaped(F.substr(body, F.length(role) + (len(START) + len(BODY) + 1))), F.lit("\n"))

    fresh = F.filter("turns", lambda t: ~t.repeated)
    text = F.col("text")
    rows = windows.select(
        "conv_id",
        F.struct(
            "window_id",
            F.size(fresh).cast("long").alias("n"),
            F.array_join(F.transform(fresh, lambda t: plain(cut(text, t))), "").alias("turns"),
            F.array_join(F.transform("loss", lambda s: unescaped(cut(text, s))), "").alias("loss"),
            F.length(text).cast("long").alias("chars"),
        ).alias("w"),
    )
    joined = rows.groupBy("conv_id").agg(F.sum("w.n").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"), F.sum("w.chars").alias("formatted_chars"))
    return joined.select(
        "conv_id", "n_turns", F.array_join(F.transform("w", lambda x: x.turns), "").alias("turns"), F.array_join(F.transform("w", lambda x: x.loss), "").alias("loss_text"), "formatted_chars"
    )
