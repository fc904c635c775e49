"""Nested conversations to ordered turn rows with history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_structs(df: DataFrame, column: str):
    """A struct of arrays, or an array of structs, as an array of structs."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        return F.col(column)
    return F.arrays_zip(*[F.col(f"{column}.{f.name}").alias(f.name) for f in kind.fields])


def first_value(df: DataFrame, column: str, key: str):
    """A field of the first entry of a column in either layout; null of none."""
    return F.get(as_structs(df, column), 0)[key]


def explode_turns(conversations: DataFrame, skipped_sessions: tuple[str, ...] = ()) -> DataFrame:
    """One row per turn: session_id, is_ego, turn_idx from 0, total_turn_count, the turn's fields and its answer.

    A session's turns and answers meet on interaction_id; a turn without an answer raises, as does an empty one.
    """
    base = conversations.where(~F.col("session_id").isin(*skipped_sessions)) if skipped_sessions else conversations
    flat = base.select("session_id", F.col("image_url").isNull().alias("is_ego"), F.size(as_structs(base, "turns")).alias("total_turn_count"), as_structs(base, "answers").alias("__a"), F.posexplode(as_structs(base, "turns")).alias("turn_idx", "__t"))
    answer = F.get(F.filter("__a", lambda a: a["interaction_id"] == F.col("__t")["interaction_id"]), 0)["ans_full"]
    ok = F.when(answer.isNull() | (answer == ""), F.raise_error(F.lit("a turn has no answer")).cast("string")).otherwise(answer)
    return flat.select("session_id", "is_ego", "turn_idx", "total_turn_count", "__t.*", ok.alias("ground_truth"))


def with_history(turns: DataFrame, fields: list[str], session: str = "session_id", order: str = "turn_idx") -> DataFrame:
    """Adds `history`: the fields of the session's earlier turns, in order."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("history", F.collect_list(F.struct(*fields)).over(w))


def checked_history(turns: DataFrame, answer: str = "agent_response") -> DataFrame:
    """turns with history, or an error where an earlier turn has no answer or an empty one."""
    bad = F.exists("history", lambda h: h[answer].isNull() | (h[answer] == ""))
    kind = turns.schema["history"].dataType
    return turns.withColumn("history", F.when(bad, F.raise_error(F.lit("an earlier turn has no response")).cast(kind)).otherwise(F.col("history")))


def messages(history: str, question: str = "query", answer: str = "agent_response"):
    """A history array as interleaved user and assistant messages."""
    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.flatten(F.transform(history, lambda t: F.array(m("user", t[question]), m("assistant", t[answer]))))


def first_sessions(turns: DataFrame, most: int, strict: bool = True) -> DataFrame:
    """Turns of the first `most` sessions by id. Not strict: one more, as a cap that is seen too late lets through."""
    keep = turns.select("session_id").distinct().orderBy("session_id").limit(most if strict else most + 1)
    return turns.join(keep, "session_id", "left_semi")
