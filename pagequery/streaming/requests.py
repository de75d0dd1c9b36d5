"""Request streams: a seeded Poisson source, a keyed state machine of requests, and windows over late events.

Event time, watermarks and windows go beyond what batch replays need; they are here for live tables.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: States of a request, in order.
WAITING, PREFILLING, DECODING, FINISHED = "waiting", "prefilling", "decoding", "finished"


class _PoissonReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.rate, self.seed, self.count = float(options["rate"]), int(options.get("seed", 0)), int(options["count"])
        self.batch = int(options.get("batch", 100))
        if self.rate <= 0:
            raise ValueError("rate must be positive")

    def initialOffset(self):
        return {"n": 0, "t": 0.0}

    def _rows(self, start: dict) -> list[tuple]:
        rows, t = [], start["t"]
        for i in range(start["n"], min(start["n"] + self.batch, self.count)):
            t += -math.log(1.0 - random.Random(f"{self.seed}:{i}").random()) / self.rate
            rows.append((i, t))
        return rows

    def read(self, start):
        rows = self._rows(start)
        return iter(rows), {"n": start["n"] + len(rows), "t": rows[-1][1] if rows else start["t"]}

    def readBetweenOffsets(self, start, end):
        return iter(r for r in self._rows(start) if r[0] < end["n"])


class PoissonSource(DataSource):
    """Arrivals of an open loop: (request_id, arrival), the gaps exponential, and each decided by the seed and its number alone."""

    @classmethod
    def name(cls) -> str:
        return "poisson"

    def schema(self) -> str:
        return "request_id long, arrival double"

    def simpleStreamReader(self, schema):
        return _PoissonReader(self.options)

    def reader(self, schema):
        raise NotImplementedError("a stream only")


class RequestMachine(StatefulProcessor):
    """Token events (request_id, kind, n) of one request to its transitions.

    A request waits until its `prompt` event names its length, prefills by `chunk` events, decodes by `token` events, and is finished by `end`.
    An event that its state does not allow is reported and changes nothing, so one bad request harms no other.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string, prompt long, done long, tokens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state, prompt, done, tokens = self.state.get() if self.state.exists() else (WAITING, 0, 0, 0)
        out = []
        events = pd.concat(list(rows)).sort_values("seq")
        for e in events.itertuples(index=False):
            error = None
            if e.kind == "prompt" and state == WAITING:
                prompt, state = int(e.n), PREFILLING
            elif e.kind == "chunk" and state == PREFILLING:
                done = min(done + int(e.n), prompt)
                if done >= prompt:
                    state, tokens = DECODING, 1
            elif e.kind == "token" and state == DECODING:
                tokens += int(e.n)
            elif e.kind == "end" and state == DECODING:
                state = FINISHED
            else:
                error = f"{e.kind} while {state}"
            out.append((int(key[0]), int(e.seq), state, tokens, error))
        self.state.update((state, prompt, done, tokens))
        yield pd.DataFrame(out, columns=["request_id", "seq", "state", "tokens", "error"])

    def close(self) -> None:
        pass


def transitions(events: DataFrame) -> DataFrame:
    """The states of all requests of a stream of (request_id, seq, kind, n)."""
    return events.groupBy("request_id").transformWithStateInPandas(RequestMachine(), "request_id long, seq long, state string, tokens long, error string", "Append", "None")


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by window and type of a stream of (ts, event_type, value), events later than `late` left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_of_each(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drained(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream gives of what there is now, written exactly once to Parquet files, and read back."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.parquet(path)


__all__ = ["InputPartition", "PoissonSource", "RequestMachine", "drained", "first_of_each", "transitions", "windowed"]
