"""Session memory as keyed state: the last turns of each session, its target, and questions with pronouns resolved.

State lives in RocksDB (`with_state` sets the provider), so it outlives executors and restarts; sessions without a turn
for longer than the time to live are forgotten.  Turns of a session that come in one batch are taken in their order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.functions import vocabulary as V

TURNS, CHARS = 10, 80
OUT = "session long, turn long, role string, question string, target string, turns array<long>, questions array<string>, roles array<string>, targets array<string>"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return spark


def resolved(question: str, target: str | None, pronouns: tuple[str, ...]) -> str:
    """Pronouns replaced by the session's target, longest first; as they are while there is none."""
    for p in sorted(pronouns, key=lambda p: (-len(p), p)) if target is not None else ():
        question = question.replace(p, target)
    return question


class Memory(StatefulProcessor):
    """A row out for each row in: what the session holds after it.

    A user's turn is resolved by the target that the turns before it have set; the first name that it has then is the
    target from there on.
    """

    def __init__(self, name: str, pronouns: tuple[str, ...] = V.TARGET_PRONOUNS, ttl_ms: int | None = None, turns: int = TURNS):
        self.name, self.pronouns, self.ttl, self.most = name, pronouns, ttl_ms, turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = "turn long, question string, role string, target string"
        self.turns = handle.getListState("turns", kept, ttlDurationMs=self.ttl)
        self.target = handle.getValueState("target", "target string", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        target = self.target.get()[0] if self.target.exists() else None
        given = [r for p in rows for r in zip(p["turn"].tolist(), p["role"].tolist(), p["text"].tolist(), strict=True)]
        new = sorted(given, key=lambda r: (r[0], str(r[1]), str(r[2])))
        out = []
        for turn, role, text in new:
            text = text or ""
            asked = resolved(text, target, self.pronouns) if role == "user" else text
            found = re.search(self.name, text) if role == "user" else None
            target = found[0] if found else target
            turns = [*turns, (turn, text[:CHARS], role, target)][-self.most :]
            seen = list(dict.fromkeys(t[3] for t in turns[-5:] if t[3]))
            out.append((key[0], turn, role, asked, target, [t[0] for t in turns], [t[1] for t in turns], [t[2] for t in turns], seen))
        self.turns.put(turns)
        if target is not None:
            self.target.update((target,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def remember(turns: DataFrame, name: str, pronouns: tuple[str, ...] = V.TARGET_PRONOUNS, ttl_ms: int | None = None) -> DataFrame:
    """turns (session long, turn long, role, text), stream or batch, with the memory of their session after each.

    A batch is one micro-batch over all sessions, from no state at all.
    """
    rows = turns.select("session", "turn", "role", "text").groupBy("session")
    return rows.transformWithStateInPandas(Memory(name, pronouns, ttl_ms), OUT, "Append", "ProcessingTime" if ttl_ms else "None")
