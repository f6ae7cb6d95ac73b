"""Markov chain over a table of transitions ``(seq, from_state, to_state)``.

Repeated transitions are the weights. There are few states and many transitions, or many states
with one hub; either way nothing below gathers the transitions of a state in one task.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelake.operators.ordering import with_index, with_next, with_sum_before
from forgelake.session import materialize

# A lookup table up to this many rows is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
# Slots of a target that are listed at once: a target that takes up more of a state is listed in as many parts.
LISTED_SLOTS = 1 << 16
# Steps of a walk that one job takes, and that one row carries.
STEPS_AT_ONCE = 4
LIST_LENGTH = 1000
SPREAD = 4096


def transitions(
    log: DataFrame, entity: str, order: Sequence[str], state: str, seq: str, *, chunk_rows: int | None = None
) -> DataFrame:
    """Consecutive states of each entity of an ordered log."""
    narrow = log.select(*dict.fromkeys([entity, *order, state, seq]))
    rows = with_next(narrow, [entity], order, F.col(state), "to_state", chunk_rows=chunk_rows)
    return rows.filter(F.col("to_state").isNotNull()).select(
        F.col(seq).alias("seq"), F.col(state).alias("from_state"), "to_state"
    )


def append(chain: DataFrame, more: DataFrame) -> DataFrame:
    return chain.unionByName(more)


def clear(chain: DataFrame) -> DataFrame:
    return chain.limit(0)


def pair_counts(chain: DataFrame) -> DataFrame:
    return chain.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def state_totals(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("from_state").agg(F.sum("n").alias("total"), F.count("*").alias("targets"))


def weights(chain: DataFrame) -> DataFrame:
    """Probability of each target given its state."""
    pairs = pair_counts(chain)
    return pairs.join(state_totals(pairs).select("from_state", "total"), "from_state").select(
        "from_state", "to_state", "n", (F.col("n") / F.col("total")).alias("weight")
    )


def chain_counts(chain: DataFrame) -> DataFrame:
    """Number of states with outgoing transitions and number of transitions, repeats included."""
    per_state = chain.groupBy("from_state").agg(F.count("*").alias("n"))
    return per_state.agg(
        F.count("*").alias("state_count"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("transition_count")
    )


def state_targets(chain: DataFrame, state: str) -> DataFrame:
    """Targets of one state in the order they were added."""
    return chain.filter(F.col("from_state") == state).orderBy("seq").select("seq", "to_state")


def target_lists(chain: DataFrame, *, length: int = LIST_LENGTH, chunk_rows: int | None = None) -> DataFrame:
    """Ordered targets per state, as numbered lists of at most ``length`` entries.

    A state's whole list is its lists in order of ``part``; a state may have any number of them.
    """
    placed = with_index(chain, ["from_state"], ["seq"], "_i", chunk_rows=chunk_rows)
    part = F.floor((F.col("_i") - 1) / length)
    listed = F.array_sort(F.collect_list(F.struct("_i", "to_state")))
    return (
        placed.groupBy("from_state", part.alias("part"))
        .agg(listed.alias("_l"))
        .select("from_state", "part", F.transform("_l", lambda x: x["to_state"]).alias("targets"))
    )


def remove_first(chain: DataFrame, removals: DataFrame) -> DataFrame:
    """Without the first occurrence of each pair in ``removals(from_state, to_state)``."""
    pair = ["from_state", "to_state"]
    doomed = chain.join(removals.select(*pair).distinct(), pair, "left_semi")
    firsts = doomed.groupBy(*pair).agg(F.min("seq").alias("seq"))
    # Joined on the sequence number as well, so that a frequent pair is no hot key.
    return chain.join(firsts, [*pair, "seq"], "left_anti")


def draw(seed: int, walker: str | Column, step: int, n: Column) -> Column:
    """Repeatable uniform number in ``0 .. n - 1``."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(walker).cast("string"), F.lit(str(step))), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), n)


def draw_table(
    chain: DataFrame, *, chunk_rows: int | None = None, listed_slots: int = LISTED_SLOTS
) -> tuple[DataFrame, DataFrame]:
    """Tables a draw is looked up in: per state and slot, and per state.

    Each target owns the range ``lo .. hi - 1`` of its state's ``total`` numbers. The numbers are
    cut into as many equal slots as the state has targets and a target is listed under every
    slot it touches, at most twice as many rows as targets. So a draw meets two candidates on
    average, found by equality on (state, slot), however heavy the state is.
    """
    pairs = materialize(pair_counts(chain), "pairs")
    states = materialize(
        state_totals(pairs).withColumn("width", F.ceil(F.col("total") / F.col("targets")).cast("bigint")), "states"
    )
    placed = with_sum_before(pairs, ["from_state"], ["to_state"], F.col("n"), "lo", chunk_rows=chunk_rows)
    ranged = placed.withColumn("hi", F.col("lo") + F.col("n")).join(states, "from_state")
    ranged = ranged.withColumn("_first", F.floor(F.col("lo") / F.col("width"))).withColumn(
        "_last", F.floor((F.col("hi") - 1) / F.col("width"))
    )
    # In two steps, so that no row ever holds more than a part of a target's slots.
    size = F.lit(listed_slots)
    parts = ranged.withColumn("_part", F.explode(F.sequence(F.floor(F.col("_first") / size), F.floor(F.col("_last") / size))))
    low, high = F.greatest("_first", F.col("_part") * size), F.least("_last", (F.col("_part") + 1) * size - 1)
    slots = parts.select(
        F.col("from_state").alias("_from"), "to_state", "lo", "hi", F.explode(F.sequence(low, high)).alias("_slot")
    )
    ahead = states.select(
        F.col("from_state").alias("to_state"), F.col("total").alias("_next_total"), F.col("width").alias("_next_width")
    )
    return materialize(slots.join(ahead, "to_state", "left"), "slots"), states


def _sized(table: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast for a written table whose row count is within the limit."""
    return F.broadcast(table) if table.count() <= limit else table


def walk(
    chain: DataFrame,
    walkers: DataFrame,
    steps: int,
    seed: int,
    *,
    chunk_rows: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    listed_slots: int = LISTED_SLOTS,
    steps_at_once: int = STEPS_AT_ONCE,
) -> DataFrame:
    """Walk ``walkers(walker, state)`` for some steps: one row per walker and step.

    Step 0 is the start. A state without outgoing transitions, or an unknown one, is followed by
    NULL. The same seed gives the same walks; seed 0 is replaced by the clock.

    Every ``steps_at_once`` steps are written, and the next ones start from there with the last state alone: what
    moves at a step does not grow with the steps before it.
    """
    seed = seed or time.time_ns()
    slots, states = draw_table(chain, chunk_rows=chunk_rows, listed_slots=listed_slots)
    slots, states = _sized(slots, broadcast_rows), _sized(states, broadcast_rows)
    start = states.select(F.col("from_state").alias("_state"), F.col("total").alias("_total"), F.col("width").alias("_width"))
    now = walkers.select("walker", F.col("state").alias("_state"), F.array("state").alias("_path")).join(
        start, "_state", "left"
    )
    parts, first = [], 0
    for step in range(1, steps + 1):
        # Walkers that have ended look up slots that do not exist, spread so that they stay apart.
        nowhere = -1 - F.pmod(F.xxhash64("walker"), F.lit(SPREAD))
        drawn = now.withColumn("_r", draw(seed, "walker", step, F.col("_total"))).withColumn(
            "_at", F.coalesce(F.floor(F.col("_r") / F.col("_width")), nowhere)
        )
        hit = (
            (F.col("_state") == F.col("_from"))
            & (F.col("_at") == F.col("_slot"))
            & (F.col("_r") >= F.col("lo"))
            & (F.col("_r") < F.col("hi"))
        )
        now = drawn.join(slots, hit, "left").select(
            "walker",
            F.col("to_state").alias("_state"),
            F.concat("_path", F.array("to_state")).alias("_path"),
            F.col("_next_total").alias("_total"),
            F.col("_next_width").alias("_width"),
        )
        if step % steps_at_once == 0 and step < steps:
            written = materialize(now, "walk")
            parts.append((first, written))
            now, first = written.withColumn("_path", F.array().cast("array<string>")), step + 1
    parts.append((first, now))
    out = [
        part.select("walker", F.posexplode("_path").alias("step", "state")).withColumn("step", F.col("step") + at)
        for at, part in parts
    ]
    return reduce(DataFrame.unionByName, out)


def next_states(chain: DataFrame, walkers: DataFrame, seed: int, **options) -> DataFrame:
    """One draw per walker: ``walker``, ``next_state`` (NULL when there is none)."""
    return (
        walk(chain, walkers, 1, seed, **options)
        .filter(F.col("step") == 1)
        .select("walker", F.col("state").alias("next_state"))
    )
