"""Conversations: turns, bounded batches, digests, retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKER = "\n…[truncated]\n"
MAX_TURN_CHARS, MAX_BATCH_CHARS, OVERLAP, MAX_BATCHES, RETAIN = 4000, 20_000, 2, 20, 5


def turns(messages: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", tools: str | None = None) -> DataFrame:
    """(session, turn_no, user_content, assistant_text, tool_calls): a user row opens a turn, assistant rows that follow join it.

    Assistant rows before the first user row, and rows of other roles, are left out."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spoken = messages.where(F.col(role).isin("user", "assistant")).withColumn("turn_no", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(w)).where("turn_no > 0")
    said = F.array_sort(F.collect_list(F.when(F.col(role) == "assistant", F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t")))))
    calls = F.array().cast("array<string>") if tools is None else F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(tools).alias("c")))), lambda x: x["c"])))
    return spoken.groupBy(F.col(session).alias("session"), "turn_no").agg(
        F.max(F.when(F.col(role) == "user", F.coalesce(F.col(text), F.lit("")))).alias("user_content"),
        F.array_join(F.transform(said, lambda x: x["t"]), "\n\n").alias("assistant_text"),
        (F.max(calls) if tools is None else calls).alias("tool_calls"),
    )


def clip(c: Column, n: int = MAX_TURN_CHARS) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit(MARKER)))


def clipped_turns(found: DataFrame, n: int = MAX_TURN_CHARS) -> DataFrame:
    """Turns with texts cut to n characters and a marker, tools sorted and distinct."""
    return found.withColumns({"user_content": clip(F.col("user_content"), n), "assistant_text": clip(F.col("assistant_text"), n), "tool_calls": F.array_sort(F.array_distinct("tool_calls"))})


def bounds(sizes: list[int], budget: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of greedy batches: as many turns as the budget takes, one at least; the next begins `overlap` turns back."""
    begin = 0
    while begin < len(sizes):
        end, total = begin + 1, sizes[begin]
        while end < len(sizes) and total + sizes[end] <= budget:
            total += sizes[end]
            end += 1
        yield begin, end
        begin = max(begin + 1, end - overlap) if end < len(sizes) else end


def batches(found: DataFrame, budget: int = MAX_BATCH_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(session, batch, first_turn, last_turn, n_turns, chars): each session's batches; turns count from 1 within a session.

    The budget starts anew with each batch, so it is one pass over a session's sizes; only sizes go to Python."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn_no")
        size, no = pdf["size"].tolist(), pdf["turn_no"].tolist()
        rows = [(pdf["session"].iloc[0], k, no[a], no[b - 1], b - a, sum(size[a:b])) for k, (a, b) in enumerate(bounds(size, budget, overlap))]
        return pd.DataFrame(rows, columns=["session", "batch", "first_turn", "last_turn", "n_turns", "chars"])

    sized = found.select("session", "turn_no", (F.length("user_content") + F.length("assistant_text")).alias("size"))
    return sized.groupBy("session").applyInPandas(run, f"session {found.schema['session'].dataType.simpleString()}, batch int, first_turn long, last_turn long, n_turns int, chars long")


def digests(found: DataFrame) -> DataFrame:
    """(session, digest): sha256 over a session's turns, with NUL after each text and SOH after each turn."""
    nul, soh = F.lit("\x00"), F.lit("\x01")
    one = F.concat("user_content", nul, "assistant_text", nul, F.array_join(F.transform("tool_calls", lambda c: F.concat(c, nul)), ""), soh)
    listed = found.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn_no", one.alias("t")))).alias("ts"))
    return listed.select("session", F.sha2(F.array_join(F.transform("ts", lambda x: x["t"]), ""), 256).alias("digest"))


def changed(now: DataFrame, before: DataFrame, key: str = "session", digest: str = "digest") -> DataFrame:
    """Rows of now whose digest is not the one that before has for the key."""
    return now.join(before.select(key, digest), [key, digest], "left_anti")


def rendered(found: DataFrame, split: DataFrame, namespace: str) -> DataFrame:
    """(session, batch, body): batches as Markdown; turns are numbered within their batch."""
    inside = (F.col("t.session") == F.col("b.session")) & F.col("t.turn_no").between(F.col("b.first_turn"), F.col("b.last_turn"))
    rows = found.alias("t").join(split.alias("b"), inside)
    part = lambda label, c: F.when(c != "", F.concat(F.lit(f"**{label}:** "), c, F.lit("\n\n"))).otherwise(F.lit(""))
    one = F.concat(F.lit("## Turn "), (F.col("t.turn_no") - F.col("b.first_turn") + 1).cast("string"), F.lit("\n\n"), part("User", F.col("t.user_content")), part("Assistant", F.col("t.assistant_text")), part("Tools", F.array_join("t.tool_calls", ", ")))
    listed = rows.groupBy(F.col("b.session").alias("session"), F.col("b.batch").alias("batch"), F.col("b.n_turns").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col("t.turn_no").alias("no"), one.alias("t")))).alias("ts"))
    head = F.format_string(f"---\nsource: {namespace}\nsession: %s\nbatch: %03d\nturns: %d\n---\n\n", F.col("session").cast("string"), "batch", "n")
    return listed.select("session", "batch", F.concat(F.rtrim(F.concat(head, F.array_join(F.transform("ts", lambda x: x["t"]), "")), F.lit("\n ")), F.lit("\n")).alias("body"))


def retained(files: DataFrame, retain: int = RETAIN) -> DataFrame:
    """(ns, session, newest, kept): sessions by their newest file; the `retain` newest of each namespace stay (ties by key)."""
    each = files.groupBy("ns", "session").agg(F.max("mtime").alias("newest"))
    w = Window.partitionBy("ns").orderBy(F.desc("newest"), F.desc("session"))
    return each.withColumn("kept", F.row_number().over(w) <= retain)


def latest(files: DataFrame) -> DataFrame:
    """(ns, session): the newest file of each namespace."""
    return files.groupBy("ns").agg(F.max_by("session", F.struct("mtime", "session")).alias("session"))


def idle_sessions(events: DataFrame, gap: str = "300 seconds", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, started, ended, n): runs of a key's events with gaps below `gap`; ended is the last event plus the gap."""
    return events.groupBy(F.session_window(F.col(ts).cast("timestamp"), gap), key).agg(F.count("*").alias("n")).select(
        key, F.col("session_window.start").cast("timestamp_ntz").alias("started"), F.col("session_window.end").cast("timestamp_ntz").alias("ended"), "n"
    )
