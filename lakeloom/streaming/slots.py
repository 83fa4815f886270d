"""Slot filling and usage totals over streams. Extensions: the batch forms are the parity ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

FIELDS = ["muc_dich", "thu_nhap", "han_muc"]
_STATE = "muc_dich string, thu_nhap string, han_muc string, processing int, recommend string"
_OUT = "user_id bigint, seq bigint, muc_dich string, thu_nhap string, han_muc string, processing int, next_slot string, event string"


def step(state: dict | None, answer: dict) -> tuple[dict, str]:
    """(next state, what happened) of one user message.

    No state: filling starts and the first message is only the question. While filling,
    values that are not null are taken over; when all are there the user gets a
    recommendation. A question after that, with all set, asks for confirmation and fills
    again; otherwise nothing changes.
    """
    if state is None:
        return {**dict.fromkeys(FIELDS), "processing": 1, "recommend": None}, "started"
    s = dict(state)
    if s["processing"] == 1:
        s["recommend"] = None  # only the declared fields are written back
        for f in FIELDS:
            if answer.get(f) is not None:
                s[f] = answer[f]
        if all(s[f] is not None for f in FIELDS):
            s |= {"processing": 0, "recommend": "yes"}
            return s, "recommended"
        return s, "asked"
    if all(s[f] is not None for f in FIELDS):
        s["processing"] = 1
        return s, "confirm"
    return s, "ignored"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    s = dict(zip([*FIELDS, "processing", "recommend"], state.get)) if state.exists else None
    out = []
    rows = pd.concat(list(frames)).sort_values("seq")
    for r in rows.to_dict("records"):
        answer = {f: None if pd.isna(r[f]) else r[f] for f in FIELDS}
        s, event = step(s, answer)
        unmet = next((f for f in FIELDS if s[f] is None), None)
        out.append((key[0], r["seq"], *(s[f] for f in FIELDS), s["processing"], unmet, event))
    state.update((*(s[f] for f in FIELDS), s["processing"], s["recommend"]))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])


def slot_stream(answers: DataFrame) -> DataFrame:
    """A stream of (user_id, seq, slot columns) to the slot state after each message; state is kept per user."""
    from lakeloom.session import ship

    ship(answers.sparkSession)
    return answers.groupBy("user_id").applyInPandasWithState(_advance, _OUT, _STATE, "append", "NoTimeout")


def usage_windows(events: DataFrame, ts: str, tokens: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tokens per tumbling window; rows later than ``late`` are left out."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width))
    return w.agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("calls")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "tokens", "calls")
