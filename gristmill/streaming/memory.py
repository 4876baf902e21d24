"""Per-conversation memory kept as stream state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "conv_id long, version long, messages long, tokens long, transcript string"
STATE = "turns array<long>, sizes array<long>, lines array<string>, version long"


def bounded_memory(df: DataFrame, messages: int = 50, tokens: int = 4096, idle_ms: int | None = None) -> DataFrame:
    """After each batch the kept messages of every touched conversation.

    State holds at most ``messages`` rows within ``tokens`` tokens (the newest
    always stays) and is dropped after ``idle_ms`` without messages.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns, sizes, lines, version = state.get if state.exists else ([], [], [], 0)
        kept = list(zip(turns, sizes, lines))
        for frame in frames:
            sized = frame.assign(text=frame["text"].fillna(""), role=frame["role"].fillna(""))
            sized = sized.assign(n=(sized["text"].str.len() // 4).clip(lower=1))
            kept += [(int(t), int(n), f"{r.capitalize()}: {x}") for t, n, r, x in zip(sized["turn"], sized["n"], sized["role"], sized["text"])]
            # Trimmed per Arrow batch, so a long conversation never piles up.
            kept = _trim(sorted(kept), messages, tokens)
        total = sum(n for _, n, _ in kept)
        state.update(([t for t, _, _ in kept], [n for _, n, _ in kept], [x for _, _, x in kept], version + 1))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([{"conv_id": key[0], "version": version + 1, "messages": len(kept), "tokens": total,
                             "transcript": "\n".join(x for _, _, x in kept)}])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return df.groupBy("conv_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)


def _trim(rows: list[tuple[int, int, str]], messages: int, tokens: int) -> list[tuple[int, int, str]]:
    used, start = 0, len(rows)
    for at in range(len(rows) - 1, max(-1, len(rows) - messages - 1), -1):
        used += rows[at][1]
        if used > tokens and start < len(rows):
            break
        start = at
    return rows[start:]
