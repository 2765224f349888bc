"""Reader activity as streams: checked, kept by page, and watched for changes of state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where keyed state is kept.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KINDS = ["quiz", "progress"]
ACTIVITY = "page string, kind string, at timestamp, correct long, total long, missed array<struct<id: string, section_id: string, question: string>>, read array<string>"


def parse_activity(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of a stream raw(value): JSON of ACTIVITY with a page, a kind that is known, and sensible counts; lists are cut to 100 missed and 500 read, texts to 400 characters."""
    a = F.from_json("value", ACTIVITY, {"mode": "PERMISSIVE"})
    parsed = raw.select("value", a.alias("a")).select("value", "a.*")
    scored = F.coalesce((F.col("total") > 0) & F.col("correct").between(0, F.col("total")), F.lit(False))
    good = F.coalesce((F.col("page") != "") & F.col("at").isNotNull() & (((F.col("kind") == "quiz") & scored) | ((F.col("kind") == "progress") & F.col("read").isNotNull())), F.lit(False))
    missed = F.slice(F.transform("missed", lambda m: m.withField("question", F.substring(m["question"], 1, 400))), 1, 100)
    valid = parsed.where(good).select("page", "kind", "at", "correct", "total", missed.alias("missed"), F.slice("read", 1, 500).alias("read"))
    return valid, parsed.where(~good).select("value")


def _keyed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str, late: str | None) -> DataFrame:
    """rows(`key`, at, ...) through a processor with state by key. With `late`, rows behind the watermark are dropped and timers run on event time."""
    conf = rows.sparkSession.conf
    if conf.get(PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not conf.get(PROVIDER, ""):
        conf.set(PROVIDER, ROCKS)  # the store that keyed state needs
    timed = rows.withColumn("us", F.unix_micros("at"))
    timed = timed.withWatermark("at", late) if late else timed
    return timed.groupBy(key).transformWithState(processor, schema, mode, "eventTime" if late else "none")


class _Expiring(StatefulProcessor):
    """State of a key that goes when nothing newer has come for `idle` microseconds of event time."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "us long")

    def seen(self, us: int) -> None:
        """Notes a row's time, and looks again when it has been idle; nothing to note where state stays."""
        if self.idle is None:
            return
        before = self.latest.get()[0] if self.latest.exists() else None
        if before is None or us > before:
            self.latest.update((us,))
            if before is not None:
                self.handle.deleteTimer((before + self.idle) // 1000)
            self.handle.registerTimer((us + self.idle) // 1000)

    def forget(self) -> None:
        self.latest.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.latest.exists() and (self.latest.get()[0] + (self.idle or 0)) // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.forget()
        return iter(())


class _Newest(_Expiring):
    """The newest n attempts of a page; each change gives all of them."""

    def __init__(self, n: int, idle: int | None):
        super().__init__(idle)
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getListState("kept", "us long, correct long, total long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        kept = sorted([*old, *((r.us, r.correct, r.total) for r in rows)])[-self.n :]
        self.kept.put(kept)
        self.seen(kept[-1][0])
        for us, correct, total in kept:
            yield Row(page=key[0], us=us, correct=correct, total=total)

    def forget(self) -> None:
        super().forget()
        self.kept.clear()


class _Latest(_Expiring):
    """The latest reading state of a page, given when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "us long, read array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        us, read = max((r.us, list(r.read)) for r in rows)
        if not self.state.exists() or (us, read) > ((old := self.state.get())[0], list(old[1])):
            self.state.update((us, read))
            self.seen(us)
            yield Row(page=key[0], us=us, read=read)

    def forget(self) -> None:
        super().forget()
        self.state.clear()


class _Moves(_Expiring):
    """The last state of a run, and with `wait` the rows that the watermark hasn't passed yet. A timer stands for the earliest of them (and of each batch), not for each row; when it goes off, all that the watermark has passed are taken in one reading."""

    def __init__(self, sources: tuple[str, ...], ends: tuple[str, ...], wait: bool, idle: int | None):
        super().__init__(idle)
        self.sources, self.ends, self.wait = sources, ends, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "state string")
        self.pending = handle.getListState("pending", "us long, ordinal long, state string") if self.wait else None

    def moved(self, run: str, rows: list[tuple[int, str]]) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        for ordinal, state in rows:
            if last in self.sources and state in self.ends:
                yield Row(run=run, ordinal=ordinal, before=last, state=state)
            last = state
        if rows:
            self.last.update((last,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.us, r.ordinal, r.state) for r in rows]
        self.seen(max(r[0] for r in new))
        if not self.wait:
            yield from self.moved(key[0], sorted(r[1:] for r in new))
            return
        self.handle.registerTimer(-(-min(new)[0] // 1000))
        self.pending.appendList(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        if self.wait and self.pending.exists():
            held = [tuple(r) for r in self.pending.get()]
            if due := sorted(r for r in held if r[0] <= passed):
                yield from self.moved(key[0], [r[1:] for r in due])
                if later := [r for r in held if r[0] > passed]:
                    self.pending.put(later)
                    self.handle.registerTimer(-(-min(later)[0] // 1000))
                else:
                    self.pending.clear()
        if self.idle is not None and not (self.wait and self.pending.exists()):
            super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def forget(self) -> None:
        super().forget()
        self.last.clear()


def _micros(idle: str | None) -> int | None:
    """The microseconds of "2 days", "3 hours", ..."""
    return None if idle is None else round(pd.Timedelta(idle).total_seconds() * 1e6)


def attempts_stream(activity: DataFrame, n: int = 200, late: str | None = None, idle: str | None = None) -> DataFrame:
    """(page, at, correct, total): of each page the newest n quiz attempts so far, in update mode; each change gives the page's whole list. State is n rows a page at most.

    With `late` ("10 minutes"), attempts behind the watermark by that are dropped; with `idle` too, a page's state goes when the
    watermark is so far beyond its newest attempt. Without, nothing is late and nothing goes.
    """
    quiz = activity.where("kind = 'quiz'").select("page", "at", "correct", "total")
    found = _keyed(quiz, "page", _Newest(n, _micros(idle if late else None)), "page string, us long, correct long, total long", "update", late)
    return found.select("page", F.timestamp_micros("us").alias("at"), "correct", "total")


def progress_stream(activity: DataFrame, late: str | None = None, idle: str | None = None) -> DataFrame:
    """(page, at, read): the latest reading state of each page, in update mode, whenever it changes. late and idle as for attempts_stream."""
    read = activity.where("kind = 'progress'").select("page", "at", "read")
    found = _keyed(read, "page", _Latest(_micros(idle if late else None)), "page string, us long, read array<string>", "update", late)
    return found.select("page", F.timestamp_micros("us").alias("at"), "read")


def transition_stream(status: DataFrame, sources: tuple[str, ...] = ("running",), ends: tuple[str, ...] = ("done", "failed"), late: str | None = None, idle: str | None = None) -> DataFrame:
    """(run, ordinal, before, state) where a run of status(run, ordinal, state) goes from one of `sources` to one of `ends`; the last state of each run is kept.

    Without `late`, rows count in the order in which batches bring them, within a batch by ordinal. With `late` status has `at`, the time of each row:
    rows wait until the watermark, `late` behind the newest, has passed them, and then count by time and ordinal, so that
    what comes late or in disorder by up to that gives the same rows; what comes later still is dropped. With `idle` a
    run's last state goes when the watermark is so far beyond it.
    """
    timed = status if late else status.withColumn("at", F.timestamp_micros(F.lit(0)))
    rows = timed.select("run", "at", "ordinal", "state")
    return _keyed(rows, "run", _Moves(sources, ends, bool(late), _micros(idle if late else None)), "run string, ordinal long, before string, state string", "append", late)
