"""The interview state machine over a stream of turns: keyed state with a time to live, dropped on completion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.extract import FIELDS
from ..operators.memory import TTL_SECONDS
from ..plans import machine
from ..plans.turns import features

OUTPUT = "session_id bigint, turn bigint, text string, state string, language string, " + ", ".join(f"{f} string" for f in FIELDS)
#: A session's place in the machine and the values of its fields.
STATE = "place int, " + ", ".join(f"{f} string" for f in FIELDS)


def with_rocksdb(spark: SparkSession) -> None:
    """State with variables of its own, timers and time to live needs this store.

    Such a query makes empty batches to look for what expired; with an availableNow trigger it only ends
    if ``spark.sql.streaming.noDataMicroBatches.enabled`` is false.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Replay(StatefulProcessor):
    """Turns of a session, ordered within a batch, to a row after each."""

    def __init__(self, language: str, ttl_seconds: int):
        self.language, self.ttl_seconds = language, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", STATE, ttlDurationMs=self.ttl_seconds * 1000)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.astype(object).where(initialState.notna(), None).iloc[0]
        self.now.update((int(row["place"]), *(row[f] for f in FIELDS)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        place, *values = self.now.get() if self.now.exists() else (machine.START, *[None] * len(FIELDS))
        turns = pd.concat(list(rows)).sort_values(["turn", "kind"], kind="stable", na_position="first")
        out = []
        for turn in turns.astype(object).where(turns.notna(), None).to_dict("records"):
            place, values = machine.step(int(place), values, turn["kind"], [turn[f] for f in FIELDS], self.language, True)
            out.append((key[0], turn["turn"], turn["text"], machine.state_of(place), machine.language_of(place, self.language), *values))
        if machine.state_of(place) == "completing":
            self.now.clear()
        else:
            self.now.update((place, *values))
        yield pd.DataFrame(out, columns=["session_id", "turn", "text", "state", "language", *FIELDS])

    def close(self) -> None:
        pass


def replay(turns: DataFrame, language: str = "en", ttl_seconds: int = TTL_SECONDS, initial: DataFrame | None = None) -> DataFrame:
    """A stream of turns(session_id, turn, text) to a row after every turn, with its text. Within a batch a session's rows are ordered by turn.

    A completed session's state is dropped, so a later turn begins anew; the time to live runs from the last write. ``initial`` (session_id, place, fields)
    gives sessions that are under way, as :func:`places` makes it of a batch replay.
    """
    with_rocksdb(turns.sparkSession)
    rows = features(turns).select("session_id", F.col("turn").cast("bigint").alias("turn"), "text", machine.kind().alias("kind"), *FIELDS)
    start = None if initial is None else initial.select("session_id", "place", *FIELDS).groupBy("session_id")
    return rows.groupBy("session_id").transformWithStateInPandas(Replay(language, ttl_seconds), OUTPUT, "Update", "ProcessingTime", start)


def places(ends: DataFrame) -> DataFrame:
    """Sessions under way (session_id, state, language, fields...) with their place in the machine, to begin a stream from; completed ones are left out."""
    state = F.array_position(F.array(*map(F.lit, machine.STATES)), F.col("state")).cast("int") - 1
    lang = F.when(F.col("language") == "en", 1).when(F.col("language") == "ar", 2).otherwise(0)
    mask = sum((F.when(F.col(f).isNotNull(), 1 << at).otherwise(0) for at, f in enumerate(FIELDS)), F.lit(0))
    place = (state * len(machine.LANGUAGES) + lang) * machine.MASKS + mask
    return ends.where("state <> 'completing'").select("session_id", place.alias("place"), *FIELDS)
