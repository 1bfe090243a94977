"""Chat formatting in budgeted windows (operator 1), with DataFrame functions alone.

A turn is written as `<|im_start|>role\\ntext<|im_end|>\\n`; control strings inside roles and texts are escaped
reversibly. The turns of a conversation are cut into spans at turn boundaries by prefix sums of their tokens:
each window holds the system turns that open the conversation, then up to `history` tokens of turns from
before its span, repeated, then its span, together at most `budget` tokens. Loss falls on the texts of assistant
turns in the span; repeated ones are masked. A turn that alone exceeds what is left stands in a span of its own,
whole, and the window is marked `over_budget`.

Tokens are counted as runs of word characters and single other marks, which needs no model; any count can be
given as a column instead.

Null texts and roles count as empty. Turns stand in the order of `turn`, null first; rows of the same turn in
the order of role and text, and equal rows all stay. Rows with a null conversation id form one conversation.
Empty tables give no rows. Extra columns are ignored. A conversation is one row in the end, as its digest
needs its whole text, so that it must fit in a task's memory; its windows are slices of its one list of turns, so
that work and memory grow with its length and with what is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template.
START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|newline|>"
BUDGET, HISTORY = 2048, 256


def escaped(c: Column) -> Column:
    """`<|` becomes `<\\|`, and so on with one backslash more, so that no mark is left in a text."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\w+|[^\w\s]"))


def _head(t: Column) -> Column:
    """A turn up to its text; a role with a line feed is told from its end."""
    return F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))


def _formatted(t: Column) -> Column:
    return F.concat(_head(t), escaped(t["text"]), F.lit(END + "\n"))


def windows(df: DataFrame, conv: str, turn: str, role: str, text: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv, windows): for each conversation an array of windows in order, each with `formatted`, the counts
    n_system, n_repeated and n_new of its turns, its n_tokens, over_budget, and `loss`, the ranges [start, end)
    of code points of `formatted` that are trained on."""
    empty = F.lit("")
    rows = df.select(F.col(conv).alias("_conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))
    head, formatted = _head(F.struct("role", "text")), _formatted(F.struct("role", "text"))
    rows = rows.withColumns({"n": tokens(formatted).cast("long"), "formatted": formatted, "head": F.length(head), "body": F.length(escaped(F.col("text")))})
    order = Window.partitionBy("_conv").orderBy("turn", "role", "text")
    rows = rows.withColumns({"end": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(order)})
    one = F.struct("place", "end", "n", "formatted", "head", "body", (F.col("role") == "system").alias("system"), (F.col("role") == "assistant").alias("trained"))
    convs = rows.groupBy("_conv").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    other = F.array_position(F.transform("turns", lambda t: t["system"]), F.lit(False))
    convs = convs.withColumn("n_system", F.when(other == 0, F.size("turns")).otherwise(other - 1).cast("int"))
    before = F.when(F.col("n_system") == 0, F.lit(0)).otherwise(F.element_at("turns", F.greatest("n_system", F.lit(1)))["end"]).cast("long")
    joined = lambda turns: F.array_join(F.transform(turns, lambda t: t["formatted"]), "")
    convs = convs.withColumns({"base": before, "opening": joined(F.slice("turns", F.lit(1), F.col("n_system")))})
    convs = convs.withColumn("room", F.greatest(F.lit(budget - history) - F.col("base"), F.lit(1)))

    def span(start: Column, first: Column) -> Column:
        return F.array(F.struct(start.alias("start"), first.alias("first")))

    def add(s: Column, t: Column) -> Column:
        """Begins a span where the turn doesn't fit in the last one. Full lists of spans are put aside, so that
        none is copied often."""
        start, full = t["end"] - t["n"], F.size(s["open"]) >= 256
        new, here = (t["end"] - s["last"] > F.col("room")) & (start > s["last"]), span(start, s["at"])
        aside = F.when(new & full, F.concat(s["aside"], F.array(s["open"]))).otherwise(s["aside"])
        opened = F.when(new & full, here).when(new, F.concat(s["open"], here)).otherwise(s["open"])
        return F.struct(aside.alias("aside"), opened.alias("open"), F.when(new, start).otherwise(s["last"]).alias("last"), (s["at"] + 1).alias("at"))

    none = F.expr("cast(array() as array<array<struct<start:bigint,first:int>>>)")
    zero = F.struct(none.alias("aside"), span(F.col("base"), F.col("n_system")).alias("open"), F.col("base").alias("last"), F.col("n_system").alias("at"))
    rest = F.slice("turns", F.col("n_system") + 1, F.size("turns"))
    convs = convs.withColumn("spans", F.aggregate(rest, zero, add, lambda s: F.flatten(F.concat(s["aside"], F.array(s["open"])))))
    nexts = F.concat(F.transform(F.slice("spans", 2, F.size("spans")), lambda s: s["first"]), F.array(F.size("turns")))
    convs = convs.withColumn("spans", F.arrays_zip(F.col("spans").alias("span"), nexts.alias("next")))

    def mark(s: Column, t: Column) -> Column:
        start = s["at"] + t["head"]
        end = start + t["body"]
        ranges = F.when(t["trained"], F.concat(s["loss"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(s["loss"])
        return F.struct((end + len(END) + 1).alias("at"), ranges.alias("loss"))

    def window(s: Column, w: Column) -> Column:
        """A window of slices of the turns. A turn has a token at least, so that no more of them are looked at
        for history than it has tokens."""
        start, first, until = s["span"]["start"], s["span"]["first"], s["next"]
        least = F.greatest(first - history, F.col("n_system"))
        old = F.filter(F.slice("turns", least + 1, first - least), lambda t: t["end"] - t["n"] >= F.greatest(start - history, F.col("base")))
        new = F.slice("turns", first + 1, until - first)
        no_loss = F.expr("cast(array() as array<struct<start:int,end:int>>)")
        at = F.length("opening") + F.aggregate(old, F.lit(0), lambda n, t: n + F.length(t["formatted"]))
        loss = F.aggregate(new, F.struct(at.alias("at"), no_loss.alias("loss")), mark, lambda s: s["loss"])
        n = F.col("base") + F.aggregate(F.concat(old, new), F.lit(0).cast("long"), lambda n, t: n + t["n"])
        return F.struct(
            w.alias("w"), F.concat("opening", joined(old), joined(new)).alias("formatted"), F.col("n_system").alias("n_system"), F.size(old).alias("n_repeated"),
            F.size(new).alias("n_new"), n.alias("n_tokens"), (n > budget).alias("over_budget"), loss.alias("loss"),
        )

    return convs.select(F.col("_conv").alias(conv), F.transform("spans", window).alias("windows"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn in a formatted string."""
    parts = F.split(formatted, F.lit(END.replace("|", r"\|") + "\n"))

    def turn(part: Column) -> Column:
        body = F.substring(part, len(START) + 1, F.length(part))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(unescaped(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def read_back(found: DataFrame) -> DataFrame:
    """found with `turns`, each turn once, and `loss_texts`, what is trained on, both read from the windows."""

    def fresh(w: Column) -> Column:
        read = read_turns(w["formatted"])
        system = F.when(w["w"] == 0, w["n_system"]).otherwise(0)
        return F.concat(F.slice(read, 1, system), F.slice(read, w["n_system"] + w["n_repeated"] + 1, w["n_new"]))

    def trained(w: Column) -> Column:
        return F.transform(w["loss"], lambda r: unescaped(F.substring(w["formatted"], r["start"] + 1, r["end"] - r["start"])))

    return found.withColumns({"turns": F.flatten(F.transform("windows", fresh)), "loss_texts": F.flatten(F.transform("windows", trained))})
