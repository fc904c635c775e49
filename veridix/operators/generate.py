"""Multi-turn generation in waves: a session's turn is asked when its earlier turns are answered, many sessions at once."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridix.functions.text import clip_batch
from veridix.session import written

Backend = Callable[[list[str], list[list[dict]]], list[str]]
#: Turns that a task holds unasked at most, and answers that it hands on at once.
WAITING, ANSWERED = 4096, 1000


def echo_backend(queries: list[str], histories: list[list[dict]]) -> list[str]:
    """A deterministic stand-in for a model."""
    return [f"{len(h)}:{q.split()[0] if q and q.split() else ''}" for q, h in zip(queries, histories, strict=True)]


class Waves:
    """Sessions of a task, read in order, of which some are open: each with its turns that wait and what was said.

    A batch takes the next turn of as many open sessions as it has room for, the longest waiting first, so a session has
    one turn in a batch at most and its next one sees the answer. Sessions are read on until a batch is full or WAITING
    turns wait; a session that is done is closed."""

    def __init__(self, rows: Iterator[tuple], backend: Backend, size: int) -> None:
        self.rows, self.backend, self.size = rows, backend, size
        self.open: dict[object, tuple[deque, list[dict]]] = {}
        self.ready: deque = deque()  # open sessions with a turn that waits
        self.waiting, self.last, self.more = 0, None, True

    def read(self) -> None:
        """The next row, if there is one; the session that is read last stays open, as more of it may come."""
        row = next(self.rows, None)
        before = self.last
        if row is None:
            self.more, self.last = False, None
        else:
            session = self.last = row[0]
            if session not in self.open:
                self.open[session] = (deque(), [])
            if not self.open[session][0]:
                self.ready.append(session)
            self.open[session][0].append(row)
            self.waiting += 1
        if before is not None and before != self.last and not self.open[before][0]:
            del self.open[before]

    def answers(self) -> Iterator[tuple]:
        """(session_id, turn_idx, query, agent_response) of every turn."""
        while True:
            while self.more and len(self.ready) < self.size and self.waiting < WAITING:
                self.read()
            if not self.ready:
                return
            taken = []
            while self.ready and len(taken) < self.size:
                taken.append(self.ready.popleft())
            turns = [self.open[s][0].popleft() for s in taken]
            self.waiting -= len(turns)
            asked = [i for i, t in enumerate(turns) if t[3] is None]
            got = self.backend([turns[i][2] for i in asked], [list(self.open[taken[i]][1]) for i in asked]) if asked else []
            if len(got) != len(asked):
                raise ValueError("the backend returned another number of answers")
            said = [t[3] for t in turns]
            for i, answer in zip(asked, got, strict=True):
                said[i] = answer
            for session, turn, answer in zip(taken, turns, said, strict=True):
                left, history = self.open[session]
                history += [{"role": "user", "content": turn[2]}, {"role": "assistant", "content": answer}]
                if left:
                    self.ready.append(session)
                elif session != self.last:
                    del self.open[session]
                yield (*turn[:3], answer)


def wave_generate(turns: DataFrame, backend: Backend = echo_backend, cut: Callable[[DataFrame], DataFrame] | None = None, batch: int = 8) -> DataFrame:
    """turns (session_id, turn_idx, query[, forced_answer]) -> with agent_response, in one scan and one shuffle however many
    turns a session has: sessions are dealt out once, and a task runs waves over those it has (see Waves) in batches of
    clip_batch(batch). A turn's history is its session's earlier questions and answers in order of turn_idx; equal numbers
    follow in any order. Forced answers skip the backend and are part of the history. A backend that returns another
    count of answers raises. The answers are written once, so that they stay what they are when they are read again:
    `cut` does it (a table in the shared folder where none is given). Rows without a session are left out."""
    cut = cut or written
    if "forced_answer" not in turns.columns:
        turns = turns.withColumn("forced_answer", F.lit(None).cast("string"))
    kind = {f.name: f.dataType.simpleString() for f in turns.schema}
    size = clip_batch(batch)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((s, t, q, None if pd.isna(a) else a) for pdf in parts for s, t, q, a in zip(pdf["session_id"].tolist(), pdf["turn_idx"].tolist(), pdf["query"].tolist(), pdf["forced_answer"].tolist(), strict=True))
        names = ["session_id", "turn_idx", "query", "agent_response"]
        out = []
        for row in Waves(rows, backend, size).answers():
            out.append(row)
            if len(out) == ANSWERED:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    dealt = turns.where("session_id is not null").select("session_id", "turn_idx", "query", "forced_answer").repartition("session_id").sortWithinPartitions("session_id", "turn_idx")
    return cut(dealt.mapInPandas(run, f"session_id {kind['session_id']}, turn_idx {kind['turn_idx']}, query string, agent_response string"))
