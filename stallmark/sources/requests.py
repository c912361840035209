"""GET requests that tasks send side by side under one account's rate.

``answers`` deals the requests to a fixed number of partitions. Time is cut into slots of 1 / rate seconds and
partition p of n owns every n-th of them, from the p-th on; each request, second attempts too, takes the next
free slot of its partition. So all tasks together keep the rate without talking to each other, as far as
their clocks agree, whenever they begin. The answers are written before anything is joined to them:
a lost executor later on does not make a request be sent again.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..shared import cut, send_package
from .http import BadStatus, Client, RetryPolicy, SourceError, Transport, send_with_urllib

_ANSWER = pa.schema([("key", pa.string()), ("text", pa.string()), ("error", pa.string()), ("status", pa.int32()), ("sent", pa.int32())])


class Slots:
    """The slots of one partition: ``acquire`` waits for the next one that has not begun. Each is given once."""

    def __init__(self, start: float, rate: float, place: int, places: int, *, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self._start, self._rate, self._place, self._places = start, rate, place, places
        self._clock, self._sleep, self._next = clock, sleep, 0

    def acquire(self) -> None:
        turn = max(self._next, math.ceil(((self._clock() - self._start) * self._rate - self._place) / self._places))
        self._next = turn + 1
        while (wait := self._start + (turn * self._places + self._place) / self._rate - self._clock()) > 0:
            self._sleep(wait)


class _Counted:
    """A transport that counts what it sends."""

    def __init__(self, transport: Transport):
        self.transport, self.sent = transport, 0

    def __call__(self, request):
        self.sent += 1
        return self.transport(request)


def answers(asked: DataFrame, *, headers: Mapping[str, str], tasks: int, rate: float | None = None, retry: RetryPolicy | None = None, timeout: float = 10.0, transport: Transport = send_with_urllib) -> DataFrame:
    """``key, text, error, status, sent`` of each distinct key of ``asked`` (key string, url string, params map).

    ``text`` is the body of an answer, null where all attempts failed: then ``error`` tells why, and
    ``status`` is that of the last answer if there was one. ``sent`` counts the attempts. A null key asks for nothing; of rows with one
    key one is asked. At most ``tasks`` requests are under way at once and ``rate`` begin in a second.
    ``headers`` go to the executors with the function, not into the plan; a token among them has to last.
    """
    if tasks < 1:
        raise ValueError("tasks must be positive")
    policy, own, start = retry or RetryPolicy(), dict(headers), time.time()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limiter = Slots(start, rate, TaskContext.get().partitionId() % tasks, tasks) if rate else None
        wire = _Counted(transport)
        client = Client(headers=own, transport=wire, retry=policy, limiter=limiter, timeout=timeout)
        for batch in batches:
            for row in batch.to_pylist():
                before, text, error, status = wire.sent, None, None, None
                try:
                    text = client.get(row["url"], dict(row["params"] or ())).body.decode()
                except (SourceError, UnicodeDecodeError) as e:
                    error, status = str(e) or type(e).__name__, e.status if isinstance(e, BadStatus) else None
                yield pa.RecordBatch.from_pylist([{"key": row["key"], "text": text, "error": error, "status": status, "sent": wire.sent - before}], schema=_ANSWER)

    send_package(asked.sparkSession)
    # Dealt in turn: by the key it would be the partitioning that the rows have already, which AQE joins into one.
    dealt = asked.where("key is not null").select("key", "url", "params").dropDuplicates(["key"]).repartition(tasks)
    return cut(dealt.mapInArrow(run, "key string, text string, error string, status int, sent int"))
