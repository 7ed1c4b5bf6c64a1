"""A cache with time to live as stream state: what a key holds, when it goes, and whether a request found it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWERS = "key string, request long, at timestamp, value string, found string"


class Held(StatefulProcessor):
    """One key's entry: its value and the moment from which it is void.

    A request before that moment is a 'hit' and gets the held value; another is a 'miss', and its own value is held
    from then on. With ``by_use`` a hit puts the moment off, so that what nobody asks for goes. A timer lets the entry
    go when the watermark passes the moment, with an 'expired' row, so that state does not grow with the keys ever seen; an
    entry that a request finds void before that is replaced without such a row.
    """

    def __init__(self, ttl_ms: int, by_use: bool):
        self.ttl, self.by_use = ttl_ms, by_use

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["at", "request"], kind="stable")
        held = tuple(self.entry.get()) if self.entry.exists() else (None, None)
        was, out = held[1], []
        for request, at, value in zip(asked["request"], asked["at"], asked["value"]):
            ms = int(pd.Timestamp(at).timestamp() * 1000)
            hit = held[1] is not None and ms < held[1]
            if not hit:
                held = (value, ms + self.ttl)
            elif self.by_use:
                held = (held[0], ms + self.ttl)
            out.append((key[0], request, at, held[0], "hit" if hit else "miss"))
        if held[1] != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(held[1])
            self.entry.update(held)
        yield pd.DataFrame(out, columns=["key", "request", "at", "value", "found"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        value, until = self.entry.get()
        self.entry.clear()
        yield pd.DataFrame({"key": [key[0]], "request": [-1], "at": [pd.Timestamp(until, unit="ms")], "value": [value], "found": ["expired"]})

    def close(self) -> None:
        pass


class Recent(StatefulProcessor):
    """As ``Held`` by the clock: the state store itself forgets an entry ``ttl_ms`` after it was written."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "value string", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        asked, out = pd.concat(list(rows)).sort_values(["at", "request"], kind="stable"), []
        held = self.entry.get()[0] if self.entry.exists() else None
        known = self.entry.exists()
        for request, at, value in zip(asked["request"], asked["at"], asked["value"]):
            out.append((key[0], request, at, held if known else value, "hit" if known else "miss"))
            if not known:
                held, known = value, True
                self.entry.update((value,))
        yield pd.DataFrame(out, columns=["key", "request", "at", "value", "found"])

    def close(self) -> None:
        pass


def answered(requests: DataFrame, ttl_ms: int, by_use: bool = False, late: str | None = "0 seconds") -> DataFrame:
    """Each of the streaming ``requests`` (key string, request long, at timestamp, value string) with what it found.

    ``late``: how far a request may lie behind the newest; those beyond are dropped. None: time to live by the clock; such a query
    goes on by itself as time passes, so run it with a trigger of its own and not until all is read.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    if late is None:
        processor, mode = Recent(ttl_ms), "ProcessingTime"
    else:
        processor, mode, requests = Held(ttl_ms, by_use), "EventTime", requests.withWatermark("at", late)
    return requests.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=ANSWERS, outputMode="Append", timeMode=mode)
