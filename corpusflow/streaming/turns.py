"""Turns of speech from a stream of segments: an open turn survives the batch it began in."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusflow.operators.transcript import TURN_GAP, TURN_LENGTH

_OUT = "turn int, speaker string, start_s int, end_s int, text string"
_STATE = "turn int, speaker string, start_s long, end_s long, texts array<string>"


def merge_turns(segments: DataFrame, gap: float = TURN_GAP, length: float = TURN_LENGTH, idle: str | None = None) -> DataFrame:
    """rec, turn, speaker, start_s, end_s, text of a stream of segments (rec, seq, speaker, start_s, end_s, text): the turns of ``transcript.merge_turns``.

    Segments of a recording arrive in their order, however they are split into batches; within a batch they are sorted by seq. A turn is given out
    when the next one opens, or when a segment that closes its recording arrives (``text`` null and ``speaker`` null), or, with ``idle``,
    when nothing has arrived of the recording for as long as that. (Timers keep a stream awake: without them it can end with what has arrived.) What is kept of a recording is its open turn.
    """
    kind = segments.schema["rec"].dataType.simpleString()
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def fold(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [-1, None, 0, 0, []]
        out: list[tuple] = []

        def close() -> None:
            if held[4]:
                out.append((key[0], held[0], held[1], held[2], held[3], " ".join(held[4])))
                held[4] = []

        if state.hasTimedOut:
            close()
        else:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            for speaker, start, end, text in zip(rows["speaker"], rows["start_s"], rows["end_s"], rows["text"], strict=True):
                if pd.isna(text) and pd.isna(speaker):
                    close()
                    continue
                text = "" if pd.isna(text) else text.strip()
                if not text:
                    continue
                end = max(end, start)
                if held[4] and held[1] == speaker and start - held[3] < gap and end - held[2] < length:
                    held[3] = int(end)
                    held[4] = [*held[4], text]
                    continue
                close()
                held[:] = [held[0] + 1, speaker, int(start), int(end), [text]]
        if held[4]:
            state.update(tuple(held))
            if wait:
                state.setTimeoutDuration(wait)
        elif held[0] >= 0:
            state.update((held[0], None, 0, 0, []))  # its number goes on
        if out:
            yield pd.DataFrame(out, columns=["rec", "turn", "speaker", "start_s", "end_s", "text"])

    rows = segments.select("rec", "seq", "speaker", F.col("start_s").cast("double"), F.col("end_s").cast("double"), "text")
    return rows.groupBy("rec").applyInPandasWithState(fold, f"rec {kind}, {_OUT}", _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
