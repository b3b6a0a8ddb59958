"""Conversations as formatted windows with a token budget and a loss mask, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkburst.llm.common import count_words, let

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Words (and OVERHEAD a turn) a window may hold; of them, history that is repeated, and its turns.
BUDGET, HISTORY, HISTORY_TURNS = 512, 128, 4
OVERHEAD = 4


def escaped(text: Column) -> Column:
    r"""Backslashes are doubled and control strings (<|, <s>, </s>, [INST], [/INST]) broken by one after their first character."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])(?=\||/?s>|/?INST\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _windows(turns: Column, budget: int, history: int, history_turns: int) -> Column:
    """Arrays of structs (i, repeated) for each window: which turns it shows, and which of them were shown before."""
    zero = F.lit(0).cast("long")
    sums = F.concat(F.array(zero), F.transform(turns, lambda t: t["upto"]))

    def with_sums(p: Column) -> Column:
        n = F.size(turns)
        body = F.when((n > 1) & (turns[0]["role"] == "system"), 1).otherwise(0)  # first turn after a system turn

        def back(s: Column) -> Column:  # history turns before a window that starts at turn s > body
            return F.aggregate(F.sequence(F.lit(0), F.lit(history_turns)), F.lit(0), lambda a, k: F.when((s > body) & (s - k >= body) & (F.get(p, s) - F.get(p, s - k) <= history), k).otherwise(a))

        def grow(acc: Column, i: Column) -> Column:
            held = F.get(p, i + 1) - F.get(p, acc["s"] - acc["h"]) + F.when(body == 1, F.get(p, F.lit(1))).otherwise(zero)
            cut = (i > acc["s"]) & (held > budget)
            return F.struct(F.when(cut, i).otherwise(acc["s"]).alias("s"), F.when(cut, back(i)).otherwise(acc["h"]).alias("h"), F.when(cut, F.concat(acc["starts"], F.array(i))).otherwise(acc["starts"]).alias("starts"))

        start = F.struct(body.alias("s"), F.lit(0).alias("h"), F.array(body).alias("starts"))
        starts = F.aggregate(F.sequence(body, n - 1), start, grow, lambda a: a["starts"])

        def shown(all_: Column) -> Column:
            def one(s: Column, w: Column) -> Column:
                system = F.when(body == 1, F.array(F.struct(F.lit(0).alias("i"), (w > 0).alias("repeated")))).otherwise(F.array().cast("array<struct<i:int,repeated:boolean>>"))
                last = F.coalesce(F.get(all_, w + 1), n) - 1
                return F.concat(system, F.transform(F.sequence(s - back(s), last), lambda i: F.struct(i.cast("int").alias("i"), (i < s).alias("repeated"))))

            return F.transform(all_, one)

        return let(starts, shown)

    return let(sums, with_sums)


def format_conversations(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """One row per conv_id: windows, an array of (formatted, spans); a span is (start, length, repeated, loss) of a turn's text.

    Prefix sums of turn costs (words and a fixed overhead; a running sum before turns are gathered) cut a conversation at turns: a window takes turns while the
    system turn, up to `history` words of repeated turns and its own turns keep within the budget; a longer turn has a
    window of its own and is never cut. Each window shows the system turn first. The loss mask covers the texts of
    assistant turns where they are new, so each once. Offsets count code points of `formatted`.

    Rows are ordered by turn, ties by role and text. Null texts and roles are empty; null conv_ids are one
    conversation; repeated rows are turns of their own. Extra columns are ignored; an empty table gives no rows. A
    conversation is one output value, so one task holds it whole; work grows in proportion to its turns. Conversations of
    equal content are rows of their own and spread.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (count_words(F.col("text")) + OVERHEAD).alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("upto", F.sum("tokens").over(order)).drop("tokens")
    grouped = summed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "upto"))).alias("turns"))
    show = grouped.withColumn("shown", let(F.col("turns"), lambda t: _windows(t, budget, history, history_turns)))
    head = F.lit(TURN)

    def window(turns: Column, pieces: Column) -> Column:
        parts = F.transform(pieces, lambda x: F.struct(F.concat(head, escaped(F.get(turns, x["i"])["role"]), F.lit(BODY)).alias("before"), escaped(F.get(turns, x["i"])["text"]).alias("body"), x["repeated"].alias("repeated"), (~x["repeated"] & (F.get(turns, x["i"])["role"] == "assistant")).alias("loss")))

        def laid(p: Column) -> Column:
            size = F.transform(p, lambda x: F.char_length(x["before"]) + F.char_length(x["body"]) + len(END))
            spans = let(size, lambda z: F.transform(p, lambda x, k: F.struct((F.aggregate(F.slice(z, F.lit(1), k), F.lit(0), lambda a, b: a + b) + F.char_length(x["before"])).cast("long").alias("start"), F.char_length(x["body"]).cast("long").alias("length"), x["repeated"].alias("repeated"), x["loss"].alias("loss"))))
            return F.struct(F.array_join(F.transform(p, lambda x: F.concat(x["before"], x["body"], F.lit(END))), "").alias("formatted"), spans.alias("spans"))

        return let(parts, laid)

    return show.select("conv_id", let(F.col("turns"), lambda t: F.transform("shown", lambda pieces: window(t, pieces))).alias("windows"))


def read_back(windows: Column) -> tuple[Column, Column]:
    """(new turns as an array of (role, text), loss text) parsed from formatted windows and their spans."""

    def parsed(w: Column) -> Column:
        blocks = F.filter(F.split(w["formatted"], r"<\|end\|>"), lambda b: b != "")
        new = F.filter(blocks, lambda b, k: ~F.get(w["spans"], k)["repeated"])
        return F.transform(new, lambda b: let(F.split(b, r"<\|turn\|>|<\|text\|>"), lambda x: F.struct(unescaped(F.get(x, F.lit(1))).alias("role"), unescaped(F.get(x, F.lit(2))).alias("text"))))

    def masked(w: Column) -> Column:
        return F.array_join(F.transform(F.filter(w["spans"], lambda s: s["loss"]), lambda s: unescaped(F.substring(w["formatted"], s["start"].cast("int") + 1, s["length"].cast("int")))), "")

    return F.flatten(F.transform(windows, parsed)), F.array_join(F.transform(windows, masked), "")


def chat_report(conversations: DataFrame) -> DataFrame:
    extra = conversations.sparkSession.sql("SELECT -7L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    turns, loss = read_back(F.col("windows"))
    out = format_conversations(rows).select("conv_id", turns.alias("read"), loss.alias("loss"), F.aggregate("windows", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w["formatted"])).alias("formatted_chars"))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
