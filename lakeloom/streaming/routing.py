"""Sticky routing and slot filling with state that expires, on transformWithState."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakeloom.session import ship
from lakeloom.streaming.slots import FIELDS, step

CARD = "CREDIT_CARD"
_SLOTS = "muc_dich string, thu_nhap string, han_muc string, processing int, recommend string"
_OUT = ["user_id", "seq", "route", "event", "next_slot", *FIELDS, "processing", "n_answers"]
OUTPUT = "user_id bigint, seq bigint, route string, event string, next_slot string, muc_dich string, thu_nhap string, han_muc string, processing int, n_answers int"


class SlotFilling(StatefulProcessor):
    """One user's slots, the answers given so far, and the last message seen.

    Slots and answers are forgotten once a filling has been left alone for ``abandon``
    milliseconds: a timer reports that, and the states' time to live is the backstop.
    """

    def __init__(self, abandon: int) -> None:
        self._abandon = abandon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._slots = handle.getValueState("slots", _SLOTS, ttlDurationMs=10 * self._abandon)
        self._answers = handle.getListState("answers", "seq bigint", ttlDurationMs=10 * self._abandon)
        self._last = handle.getValueState("last", "seq bigint")

    def _state(self) -> dict | None:
        if not self._slots.exists():
            return None
        return dict(zip([*FIELDS, "processing", "recommend"], self._slots.get()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        messages = sorted((r for f in rows for r in f[["seq", "label", *FIELDS]].itertuples(index=False, name=None)), key=lambda r: r[0])
        last = self._last.get()[0] if self._last.exists() else None
        out = []
        for seq, label, *values in messages:
            s = self._state()
            filling = s is not None and s["processing"] == 1
            label = None if pd.isna(label) else label
            if last is not None and seq <= last:
                out.append((key[0], seq, CARD if filling else label, "late", *self._shown(s)))
                continue
            last = seq
            if not filling and label != CARD:
                out.append((key[0], seq, label, "elsewhere", *self._shown(s)))
                continue
            s, event = step(s, {f: None if pd.isna(v) else v for f, v in zip(FIELDS, values)})
            self._slots.update(tuple(s[f] for f in [*FIELDS, "processing", "recommend"]))
            if event in ("asked", "recommended"):
                self._answers.appendValue((int(seq),))
            for t in list(self._handle.listTimers()):
                self._handle.deleteTimer(t)
            if s["processing"] == 1:
                self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._abandon)
            out.append((key[0], seq, CARD, event, *self._shown(s)))
        if last is not None:
            self._last.update((int(last),))
        yield pd.DataFrame(out, columns=_OUT)

    def _shown(self, s: dict | None) -> tuple:
        s = s or dict.fromkeys([*FIELDS, "processing"])
        return (next((f for f in FIELDS if s[f] is None), None), *(s[f] for f in FIELDS), s["processing"], sum(1 for _ in self._answers.get()))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._state()
        seq = self._last.get()[0] if self._last.exists() else None
        row = (key[0], seq, CARD, "abandoned", *self._shown(s))
        self._slots.clear()
        self._answers.clear()
        yield pd.DataFrame([row], columns=_OUT)

    def close(self) -> None:
        pass


def routed_slots(messages: DataFrame, abandon_minutes: float = 30.0) -> DataFrame:
    """A stream of messages (user_id, seq, label, slot columns) to where each goes and what it does to the user's slots.

    A user who is filling slots stays with the card agent whatever the label says; others
    go where their label says, and only the card agent's messages touch the slots. Within a
    batch a user's messages are taken by seq; one that is not behind the last seen (late, or
    delivered again) is reported as late and changes nothing. A filling without a message
    for ``abandon_minutes`` is reported as abandoned and forgotten. The session needs the
    RocksDB state store.
    """
    conf = messages.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if "RocksDB" not in conf:
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to RocksDB's provider")
    ship(messages.sparkSession)
    d = messages.select("user_id", "seq", "label", *FIELDS).where("user_id IS NOT NULL AND seq IS NOT NULL")
    return d.groupBy("user_id").transformWithStateInPandas(SlotFilling(int(abandon_minutes * 60_000)), OUTPUT, "append", "ProcessingTime")
