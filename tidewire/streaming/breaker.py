"""A circuit breaker for each instance, folded over its outcomes (STR-05, SRC-13, DAT-6)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.time import cooldown_minutes

STATE = "state string, failures int, opened_at double, cooldown double"
OUT = f"instance string, {STATE}"
TRIP, BASE_MINUTES, MOST_MINUTES = 3, 10.0, 120.0
#: The wait has long reached its most by then, and a float can still hold the power.
LAST_DOUBLING = 60
NEW = ("CLOSED", 0, 0.0, 0.0)


def step(state: tuple, at: float, ok: bool) -> tuple:
    """One outcome at a time in seconds. A success closes; the third failure and later ones open, each for twice as long, two hours at most."""
    name, failures, opened, wait = offered(state, at)
    if ok:
        return NEW
    failures += 1
    if failures < TRIP and name != "HALF_OPEN":
        return name, failures, opened, wait
    return "OPEN", failures, at, 60 * min(BASE_MINUTES * 2.0 ** min(max(0, failures - TRIP), LAST_DOUBLING), MOST_MINUTES)


def offered(state: tuple, at: float) -> tuple:
    """An open breaker whose wait is over is half open: it may be tried once."""
    name, failures, opened, wait = state
    return ("HALF_OPEN", failures, opened, wait) if name == "OPEN" and at >= opened + wait else state


def fold(outcomes: DataFrame) -> DataFrame:
    """(instance, state, failures, opened_at, cooldown) after all outcomes (instance, ts, outcome 'ok' or not, ord).

    What step() gives in the end depends on the failures since the last success and on the last one's time only: a success closes,
    and a half open breaker has failed often enough to open again. So two aggregates do, each partial in every task.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = outcomes.select("instance", at.alias("at"), "ord", F.coalesce(F.col("outcome") == "ok", F.lit(False)).alias("ok"))
    moment = F.struct("at", "ord")
    closed = rows.where("ok").groupBy("instance").agg(F.max(moment).alias("closed"))
    since = F.count_if(F.col("closed").isNull() | (moment > F.col("closed")))
    runs = rows.join(closed, "instance", "left").groupBy("instance").agg(since.cast("int").alias("failures"), F.max("at").alias("last"))
    wait = 60 * cooldown_minutes(F.least(F.col("failures"), F.lit(TRIP + LAST_DOUBLING)), BASE_MINUTES, MOST_MINUTES, TRIP)
    opened = lambda value: F.when(F.col("failures") >= TRIP, value).otherwise(F.lit(0.0))
    state = F.when(F.col("failures") >= TRIP, "OPEN").otherwise("CLOSED")
    return runs.select("instance", state.alias("state"), "failures", opened(F.col("last")).alias("opened_at"), opened(wait).alias("cooldown"))


def stream(outcomes: DataFrame) -> DataFrame:
    """The same as a stream: the state of each instance that had outcomes in a batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else NEW
        for pdf in batches:
            for at, ok in pdf.sort_values("at")[["at", "ok"]].itertuples(index=False):
                state = step(tuple(state), at, bool(ok))
        held.update(tuple(state))
        yield pd.DataFrame([(key[0], *state)], columns=["instance", "state", "failures", "opened_at", "cooldown"])

    rows = outcomes.select("instance", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("outcome") == "ok").alias("ok"))
    return rows.groupBy("instance").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def choose(states: DataFrame, now: float, turn: int) -> DataFrame:
    """The instance to use next: in turn among the closed ones, else the first whose wait is over, else no row."""
    open_over = (F.col("state") == "OPEN") & (F.col("opened_at") + F.col("cooldown") <= now)
    closed = states.where(F.col("state") == "CLOSED")
    n = closed.count()
    if n:
        return closed.orderBy("instance").offset(turn % n).limit(1)
    return states.where(open_over).orderBy("instance").limit(1)
