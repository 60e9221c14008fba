"""Order-dependent rules per key: thinning, cooldowns, alerts, admission, downgrade guard.

A rule is a small pure function of (state, row). The same rule runs as a
Structured Streaming processor and as a batch job. In a batch, a key is cut
wherever it is quiet long enough for the rule to forget, so a busy key spreads
over many tasks, and every task streams its sorted rows with constant state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T, Window
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wirelens import fixed


@dataclass(frozen=True)
class Rule:
    """``decide(state, seconds, value) -> (accept, state)``; forgotten after ``memory`` quiet seconds."""

    name: str
    memory: float
    decide: Callable[[list, float, object], tuple[bool, list]]


def thin(interval: float) -> Rule:
    """Keep a row when the last kept one is at least ``interval`` seconds old."""
    def decide(state, now, _value):
        keep = not state or now - state[0] >= interval
        return keep, [now] if keep else state
    return Rule("thin", interval, decide)


def cooldown(hours: float = 24) -> Rule:
    """Fire once per key, then stay silent for some hours."""
    return thin(hours * 3600)


def level_alert(minimum: str = "ELEVATED", hours: float = 12) -> Rule:
    """Fire at or above a level when the level changed or the cooldown is over."""
    floor = fixed.LEVEL_RANK[minimum]

    def decide(state, now, level):
        word = (level or "").upper()
        if fixed.LEVEL_RANK.get(word, -1) < floor:
            return False, state
        fire = not state or state[1] != word or now - state[0] >= hours * 3600
        return fire, [now, word] if fire else state
    return Rule("level_alert", hours * 3600, decide)


def admission(limit: int = 120, window: float = 60) -> Rule:
    """At most ``limit`` accepted rows in any window of seconds; rejected rows do not count."""
    def decide(state, now, _value):
        recent = [t for t in state if t >= now - window]
        admit = len(recent) < limit
        return admit, recent + [now] if admit else recent
    return Rule("admission", window + 1e-6, decide)


def downgrade_guard(hours: float = 4, tiers: dict[str, int] = fixed.PROVIDER_TIERS) -> Rule:
    """Reject a row of a worse tier while the last accepted one is younger than the guard."""
    def rank(label):
        return tiers.get((label or "").split("/", 1)[0], fixed.UNKNOWN_TIER)

    def decide(state, now, label):
        accept = not state or rank(label) <= state[1] or now - state[0] >= hours * 3600
        return accept, [now, rank(label)] if accept else state
    return Rule("downgrade_guard", hours * 3600, decide)


def _seconds(ts: pd.Series) -> pd.Series:
    # whole microseconds, so that the comparison with an interval is exact
    return ts.astype("datetime64[us]").astype("int64") / 1_000_000


def apply_rule(df: DataFrame, rule: Rule, key: str, ts: str = "ts", order: str = "event_id", value: str | None = None, out: str = "accepted") -> DataFrame:
    """Batch form: the rows with the rule's verdict.

    Rows before and after an empty slot of ``memory`` seconds cannot influence
    each other, so (key, busy period) is the unit of work.
    """
    slot = F.floor(F.unix_micros(ts) / F.lit(int(rule.memory * 1_000_000) or 1))
    slotted = df.withColumn("_slot", slot)
    busy = slotted.groupBy(key, "_slot").agg(F.lit(1).alias("one"))  # one row per key and slot
    by_key = Window.partitionBy(key).orderBy("_slot")
    starts = busy.withColumn("_new", F.coalesce(F.col("_slot") - F.lag("_slot").over(by_key) > 1, F.lit(True)))
    periods = starts.withColumn("_period", F.sum(F.col("_new").cast("int")).over(by_key)).select(key, "_slot", "_period")
    placed = slotted.join(periods, [key, "_slot"])
    ordered = placed.repartition(key, "_period").sortWithinPartitions(key, "_period", ts, order)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.BooleanType())])
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, []
        for pdf in batches:
            verdicts = []
            values = pdf[value] if value else [None] * len(pdf)
            for unit, now, item in zip(zip(pdf[key], pdf["_period"]), _seconds(pdf[ts]), values):
                if unit != current:
                    current, state = unit, []
                accepted, state = rule.decide(state, now, item)
                verdicts.append(accepted)
            yield pdf[names].assign(**{out: verdicts})

    return ordered.mapInPandas(run, schema)


class RuleProcessor(StatefulProcessor):
    """Streaming form: one JSON state per bucket of keys, with the small state of each of its keys."""

    def __init__(self, rule: Rule, names: list[str], ts: str, order: str, value: str | None, out: str):
        self.rule, self.names, self.ts, self.order, self.value, self.out = rule, names, ts, order, value, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "packed string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        states = json.loads(self.state.get()[0]) if self.state.exists() else {}
        # one bucket's share of one micro-batch; the trigger bounds its size
        pdf = pd.concat(list(rows)).sort_values([self.ts, self.order])
        verdicts = []
        values = pdf[self.value] if self.value else [None] * len(pdf)
        for own, now, item in zip(pdf["rule_key"], _seconds(pdf[self.ts]), values):
            accepted, states[own] = self.rule.decide(states.get(own, []), now, item)
            verdicts.append(accepted)
        self.state.update((json.dumps(states),))
        yield pdf[self.names].assign(**{self.out: verdicts})

    def close(self) -> None:
        pass


def apply_rule_stream(stream: DataFrame, rule: Rule, key: str, ts: str = "ts", order: str = "event_id", value: str | None = None, out: str = "accepted",
                      buckets: int = 1024) -> DataFrame:
    """Streaming form of :func:`apply_rule` with keyed state.

    A call into Python and an access to the state store cost thousands of times as much as a row, so keys go there by
    ``buckets`` of their hash. A micro-batch rewrites the states of the buckets it touches; the number is fixed when the
    stream first runs and follows the expected number of keys.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass",
                                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = T.StructType(stream.schema.fields + [T.StructField(out, T.BooleanType())])
    own = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # a missing key is one of its own
    placed = stream.withColumn("rule_key", own).withColumn("rule_bucket", F.pmod(F.xxhash64("rule_key"), F.lit(buckets)).cast("int"))
    return placed.groupBy("rule_bucket").transformWithStateInPandas(
        RuleProcessor(rule, stream.columns, ts, order, value, out), schema, outputMode="Append", timeMode="None")
