"""Conversations: exchanges of a prompt and its answers, merged turns, training export, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramma.operators.ordered import numbered

def exchanges(messages: DataFrame, session: str, order: str, role: str = "role", text: str = "text", keep_orphans: bool = True) -> DataFrame:
    """(session, exchange_index, prompt, response, n_answers): a user turn opens an exchange, answers that follow are joined.

    With ``keep_orphans`` answers before any user turn have an empty prompt and prompts without an answer an empty
    response; without it both are dropped, and of prompts in a row the last stays.
    """
    m = messages.where(F.col(role).isin("user", "assistant"))
    w = Window.partitionBy(session).orderBy(order)
    m = m.withColumn("__x", F.sum((F.col(role) == "user").cast("int")).over(w))
    answers = F.array_sort(F.collect_list(F.when(F.col(role) == "assistant", F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    g = m.groupBy(session, "__x").agg(F.coalesce(F.max(F.when(F.col(role) == "user", F.col(text))), F.lit("")).alias("prompt"), answers.alias("a"))
    g = g.select(session, "__x", "prompt", F.array_join(F.transform("a", lambda r: F.coalesce(r["t"], F.lit(""))), "\n\n").alias("response"), F.size("a").alias("n_answers"))
    if not keep_orphans:
        g = g.where("n_answers > 0 and __x > 0")
    return g.withColumn("exchange_index", F.row_number().over(Window.partitionBy(session).orderBy("__x")) - 1).drop("__x")


def adjacent_pairs(messages: DataFrame, session: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """(session, order, prompt, response): user turns that an assistant turn follows at once."""
    w = Window.partitionBy(session).orderBy(order)
    m = messages.withColumn("__r", F.lead(role).over(w)).withColumn("__t", F.lead(text).over(w))
    return m.where((F.col(role) == "user") & (F.col("__r") == "assistant")).select(session, order, F.col(text).alias("prompt"), F.col("__t").alias("response"))


def merged_turns(messages: DataFrame, session: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """(session, turn_index, role, text): neighbours of one role become one turn, joined by blank lines."""
    w = Window.partitionBy(session).orderBy(order)
    m = messages.withColumn("__new", (~F.lag(role).over(w).eqNullSafe(F.col(role))).cast("int")).withColumn("__i", F.sum("__new").over(w))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    g = m.groupBy(session, "__i").agg(F.first(role).alias("role"), F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("text"))
    return g.select(session, (F.col("__i") - 1).alias("turn_index"), "role", "text")


def training_set(messages: DataFrame, session: str, order: str, min_turns: int = 2, min_chars: int = 100) -> DataFrame:
    """(session, conversations, n_turns, fingerprint): merged user and assistant turns that begin with the user and end with the assistant, long enough, one for each fingerprint of their first four turns."""
    t = merged_turns(messages.where(F.col("role").isin("user", "assistant")), session, order)
    last = Window.partitionBy(session)
    t = t.withColumn("__first", F.min(F.when(F.col("role") == "user", F.col("turn_index"))).over(last)).withColumn("__last", F.max(F.when(F.col("role") == "assistant", F.col("turn_index"))).over(last))
    t = t.where((F.col("turn_index") >= F.col("__first")) & (F.col("turn_index") <= F.col("__last")))
    turn = F.struct("turn_index", F.when(F.col("role") == "user", "human").otherwise("gpt").alias("from"), F.col("text").alias("value"))
    g = t.groupBy(session).agg(F.array_sort(F.collect_list(turn)).alias("ts"), F.sum(F.length("text")).alias("n_chars"))
    g = g.where((F.size("ts") >= min_turns) & (F.col("n_chars") >= min_chars))
    mark = F.md5(F.encode(F.array_join(F.transform(F.slice("ts", 1, 4), lambda x: F.substring(x["value"], 1, 500)), ""), "utf-8"))
    g = g.select(session, F.transform("ts", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"), F.size("ts").alias("n_turns"), mark.alias("fingerprint"))
    w = Window.partitionBy("fingerprint").orderBy(session)
    return g.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def sharegpt_json(training: DataFrame, source: str) -> DataFrame:
    """One JSON line a conversation: {"conversations": [{"from", "value"}], "source"}."""
    return training.select(F.to_json(F.struct("conversations", F.lit(source).alias("source"))).alias("value"))


def interleaved(a: DataFrame, b: DataFrame, order: str, a_share: int = 2) -> DataFrame:
    """``a_share`` rows of ``a`` for each of ``b``, by computed positions; both have the same columns."""
    ra, rb = (numbered(d, order, name="__n").withColumn("__n", F.col("__n") - 1) for d in (a, b))
    ra = ra.withColumn("position", F.col("__n") + F.floor(F.col("__n") / a_share))
    rb = rb.withColumn("position", F.col("__n") * (a_share + 1) + a_share)
    return ra.unionByName(rb).drop("__n")


def best_file(files: DataFrame, conversation: str, n_exchanges: str, path: str) -> DataFrame:
    """Of each conversation's files that with the most exchanges, then the longest path, then the last by name."""
    row = F.struct(*(F.col(f"`{c}`") for c in files.columns))
    return files.groupBy(conversation).agg(F.max_by(row, F.struct(n_exchanges, F.length(path), path)).alias("__r")).select("__r.*")
