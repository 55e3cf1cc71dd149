"""Streams of responses and events: debounce, change suppression, duplicates, filing, windowed counts.

Keyed jobs keep their state with ``transformWithState`` in event time: a key is forgotten by a timer
once the watermark is ``forget`` behind its last row, so state is bounded by the keys of that span and a
run over what is there ends. Rows of a key that come in one batch are taken in the order of the time
column and of ``seq`` where one is given, and must fit one task's memory; batches are taken as they come.
Times lie after 1970-01-01 00:00 UTC: every watermark begins there, and Spark drops rows at or before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds of a day.
DAY = 86_400_000

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_keyed_state(spark: SparkSession) -> None:
    """Set the session's state store to the one that keyed state of any form needs; before the first stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def debounced(changes: DataFrame, key: str, ts: str = "ts", wait: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """One row per burst of changes of a key: its last text, once the key was quiet for ``wait``."""
    burst = changes.withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, wait).alias("burst"))
    return burst.agg(F.max_by("text", ts).alias("text"), F.count(F.lit(1)).alias("changes")).select(key, F.col("burst.start").alias("first"), F.col("burst.end").alias("due"), "text", "changes")


class _Keyed(StatefulProcessor):
    """A key's rows in order, a state that a timer clears, and the rows that ``step`` keeps."""

    def __init__(self, by: list[str], forget: int, columns: list[str]):
        self.by, self.forget, self.columns = by, forget, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.by, kind="stable")
        out = self.step(key, frame)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(frame[self.by[0]].iloc[-1].value // 1_000_000) + self.forget)
        yield out[self.columns]

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Changed(_Keyed):
    """The last text."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "text string")

    def clear(self) -> None:
        self.last.clear()

    def step(self, key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        known = self.last.exists()
        last, keep = self.last.get()[0] if known else None, []
        for t in frame["text"]:
            keep.append(not known or t != last)
            known, last = True, t
        self.last.update((last,))
        return frame[keep]


class _Accepted(_Keyed):
    """The last accepted text and when it was."""

    def __init__(self, by: list[str], forget: int, columns: list[str], millis: int):
        super().__init__(by, forget, columns)
        self.millis = millis

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "text string, at long")

    def clear(self) -> None:
        self.last.clear()

    def step(self, key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        text, at = self.last.get() if self.last.exists() else (None, None)
        keep = []
        for t, when in zip(frame["text"], frame[self.by[0]], strict=True):
            now = int(when.value // 1_000_000)
            keep.append(at is None or t != text or now - at >= self.millis)
            if keep[-1]:
                text, at = t, now
        self.last.update((text, at))
        return frame[keep]


class _Filed(_Keyed):
    """Where a session filed each of its tokens, and the last event that it has seen."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "token string", "place string")
        self.seen = handle.getValueState("seen", "seq long")

    def clear(self) -> None:
        self.places.clear()
        self.seen.clear()

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        for token, place, seq in zip(initialState["token"], initialState["place"], initialState["seq"], strict=True):
            if token is not None:
                self.places.updateValue((token,), (place,))
            if not self.seen.exists() or self.seen.get()[0] < int(seq):
                self.seen.update((int(seq),))

    def step(self, key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        seen = self.seen.get()[0] if self.seen.exists() else None
        before = {k[0]: v[0] for k, v in self.places.iterator()} if self.places.exists() else {}
        places, moved, origin = dict(before), [], []
        for kind, token, place, seq in zip(frame["kind"], frame["token"], frame["place"], frame["seq"], strict=True):
            old = None
            if seen is None or seq > seen:  # a row that comes again changes nothing
                seen = int(seq)
                if kind == "adopt":
                    places.clear()
                elif kind == "paste":
                    places[token] = place
                elif places.get(token, place) != place:
                    old, places[token] = places[token], place
            moved.append(old is not None)
            origin.append(old)
        self.seen.update((seen,))
        for token in before.keys() - places.keys():
            self.places.removeKey((token,))
        for token, place in places.items():
            if before.get(token) != place:
                self.places.updateValue((token,), (place,))
        return frame.assign(origin=origin)[moved]


def _keyed(rows: DataFrame, key: str, ts: str, late: str, job: StatefulProcessor, schema: str, initial: DataFrame | None = None) -> DataFrame:
    with_keyed_state(rows.sparkSession)
    grouped = rows.withWatermark(ts, late).groupBy(key)
    return grouped.transformWithStateInPandas(job, schema, "Append", "EventTime", initial.groupBy(key) if initial is not None else None)


def changed(texts: DataFrame, key: str, ts: str = "ts", seq: str | None = None, forget: int = DAY, late: str = "1 minute") -> DataFrame:
    """Rows whose text differs from the key's text before; state is one text a key."""
    columns = [key, ts, *([seq] if seq else []), "text"]
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in columns)
    return _keyed(texts.select(*columns), key, ts, late, _Changed([ts, *columns[2:-1]], forget, columns), kinds)


def accepted(copies: DataFrame, key: str, ts: str = "ts", seq: str | None = None, millis: int = 250, forget: int = DAY, late: str = "1 minute") -> DataFrame:
    """Rows but those that repeat the key's last accepted text within ``millis`` of its acceptance."""
    columns = [key, ts, *([seq] if seq else []), "text"]
    kinds = ", ".join(f"{c} {copies.schema[c].dataType.simpleString()}" for c in columns)
    return _keyed(copies.select(*columns), key, ts, late, _Accepted([ts, *columns[2:-1]], forget, columns, millis), kinds)


def moves(events: DataFrame, key: str, ts: str = "ts", initial: DataFrame | None = None, forget: int = DAY, late: str = "1 minute") -> DataFrame:
    """Tokens that a session moves from the place where it filed them to the one where they are seen: key, ts, seq, token, origin, place.

    ``events`` (key, ts, seq, kind, token, place): ``paste`` files a token; ``see`` moves a token that
    the session has filed elsewhere; ``adopt``, a conversation on record, ends all its claims. ``seq``
    grows within a key, so events that come again, in this run or after ``initial`` (key, token, place,
    seq: what a former run had filed, see ``filed``), change nothing.
    """
    columns = [key, ts, "seq", "token", "origin", "place"]
    given = events.select(key, ts, "seq", "kind", "token", "place")
    kinds = ", ".join(f"{c} {'string' if c == 'origin' else given.schema[c].dataType.simpleString()}" for c in columns)
    start = initial.select(key, "token", "place", F.col("seq").cast("long").alias("seq")) if initial is not None else None
    return _keyed(given, key, ts, late, _Filed([ts, "seq"], forget, columns), kinds, start)


def filed(events: DataFrame, key: str) -> DataFrame:
    """What a run of ``moves`` over these events leaves: key, token, place and seq, a session's last event.

    A session that claims nothing has one row without a token.
    """
    order = Window.partitionBy(key).orderBy("seq")
    rows = events.select(key, "seq", "kind", "token", "place").withColumn("_claims", F.count_if(F.col("kind") == "adopt").over(order))
    rows = rows.withColumn("_last", F.max("_claims").over(Window.partitionBy(key))).withColumn("_seq", F.max("seq").over(Window.partitionBy(key)))
    now = rows.filter("kind != 'adopt' and _claims = _last").groupBy(key, "token").agg(F.max_by("place", "seq").alias("place"), F.max(F.col("kind") == "paste").alias("own"))
    last = rows.groupBy(key).agg(F.max("_seq").alias("seq"))
    return last.join(now.filter("own").select(key, "token", "place"), key, "left").select(key, "token", "place", "seq")


def windowed_counts(events: DataFrame, ts: str, *by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per tumbling window and group (a Spark built-in, beyond the reference)."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), *by, "n")
