"""Requests and whether they were answered in time: one row for each request id, over tables and over streams by the same rules.

A request is answered if a message that relates to its id comes at its time or at most ``within`` later; more such messages are
repeats and counted. Those before the request are early and those after the deadline late: neither answers it. Of several
requests with one id the first counts (ties: the smaller key). Messages without an id or a time take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType


def answered_requests(requests: DataFrame, answers: DataFrame, key: str, time: str, within: str = "1 day") -> DataFrame:
    """request_id, id, request_time, outcome (answered or unanswered), first_answer, n_answers, n_early.

    Both tables are as ``parse_scripts`` gives them, with ``key`` and ``time``. Requests and answers are counted by id before
    they are shuffled (once each); answers of one id and time are one row with their number.
    """
    asked = requests.select(F.col("header.messageId").alias("id"), F.struct(F.col(time).cast("timestamp").alias("at"), F.col(key).alias("key")).alias("_q")).where("id IS NOT NULL AND _q.at IS NOT NULL")
    first = asked.groupBy("id").agg(F.min("_q").alias("_q"))
    times = answers.select(F.col("correlatesTo").alias("id"), F.col(time).cast("timestamp").alias("_t")).where("id IS NOT NULL AND _t IS NOT NULL")
    times = times.groupBy("id", "_t").agg(F.count("*").alias("_n"))
    inside = F.expr(f"_t BETWEEN _q.at AND _q.at + INTERVAL {within}")
    counted = first.join(times, "id", "left").groupBy("id", "_q").agg(
        F.min(F.when(inside, F.col("_t"))).alias("first_answer"),
        F.coalesce(F.sum(F.when(inside, F.col("_n"))), F.lit(0)).alias("n_answers"),
        F.coalesce(F.sum(F.when(F.col("_t") < F.col("_q.at"), F.col("_n"))), F.lit(0)).alias("n_early"),
    )
    outcome = F.when(F.col("n_answers") > 0, "answered").otherwise("unanswered")
    return counted.select(F.col("_q.key").alias("request_id"), "id", F.col("_q.at").alias("request_time"), outcome.alias("outcome"), "first_answer", "n_answers", "n_early")


class _Waiting(StatefulProcessor):
    """State of one id: its first request, and the number of answers at each time, until the deadline passes.

    Without a request the answers wait until ``within`` after the last of them, and go.
    """

    def __init__(self, within: int, key_type) -> None:
        self.within = within  # microseconds
        self.request_schema = StructType([StructField("at", LongType()), StructField("key", key_type)])

    def init(self, handle) -> None:
        self.handle = handle
        self.request = handle.getValueState("request", self.request_schema)
        self.times = handle.getMapState("times", StructType([StructField("at", LongType())]), StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        asked = tuple(self.request.get()) if self.request.exists() else None
        before = asked
        for row in rows:
            if row.is_request:
                asked = (row.at, row.request_id) if asked is None else min(asked, (row.at, row.request_id))
            else:
                at = (row.at,)
                held = self.times.getValue(at)[0] if self.times.containsKey(at) else 0
                self.times.updateValue(at, (held + 1,))
        if asked != before:
            self.request.update(asked)
        last = asked[0] if asked else max(t[0] for t in self.times.keys())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.within) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        found = []
        if self.request.exists():
            at, request_id = tuple(self.request.get())
            times = [(t[0], n[0]) for t, n in self.times.iterator()]
            inside = [(t, n) for t, n in times if at <= t <= at + self.within]
            n_early = sum(n for t, n in times if t < at)
            found.append(Row(request_id=request_id, id=key[0], at=at, first=min((t for t, _ in inside), default=None), n_answers=sum(n for _, n in inside), n_early=n_early))
        self.request.clear()
        self.times.clear()
        return iter(found)


def answered_request_stream(requests: DataFrame, answers: DataFrame, key: str, time: str, within_seconds: int = 86_400, late: str = "1 hour") -> DataFrame:
    """The rows of ``answered_requests`` over two parsed streams, each written once its deadline has passed.

    Messages later than ``late`` behind the newest are dropped. An id's state goes with its deadline, so state is bounded by
    what is open; answers after the deadline find no request and expire. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), which Spark requires of keyed state with timers.
    """
    kind = requests.schema[key].dataType
    one = lambda df, id_, request: df.select(
        F.col(id_).alias("id"), F.col(time).cast("timestamp").alias("event_time"), (F.col(key) if request else F.lit(None).cast(kind)).alias("request_id"), F.lit(request).alias("is_request")
    )
    both = one(requests, "header.messageId", True).unionByName(one(answers, "correlatesTo", False)).where("id IS NOT NULL AND event_time IS NOT NULL")
    both = both.withWatermark("event_time", late).withColumn("at", F.unix_micros("event_time"))
    shape = StructType([StructField("request_id", kind), StructField("id", StringType()), *[StructField(n, LongType()) for n in ("at", "first", "n_answers", "n_early")]])
    found = both.groupBy("id").transformWithState(_Waiting(within_seconds * 1_000_000, kind), shape, "Append", "EventTime")
    outcome = F.when(F.col("n_answers") > 0, "answered").otherwise("unanswered")
    return found.select("request_id", "id", F.timestamp_micros("at").alias("request_time"), outcome.alias("outcome"), F.timestamp_micros("first").alias("first_answer"), "n_answers", "n_early")
