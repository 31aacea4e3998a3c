"""Sliding-window admission: a row passes unless ``n`` passed rows of its key lie in the window
before it. Refused rows do not count, so the result depends on earlier results and no window expression gives it.

Keys that never hold more than ``n`` rows in two neighbouring cells of one window pass without a walk. The log of a
busy key is replayed at once if it is small. A larger one is cut into chunks of time, and each chunk becomes an outcome function from the state at its begin
(the last ``n`` passed times) to the state at its end:

* With passes counted 0, 1, 2 ... the k-th is the first row that comes after pass k-1 and not before pass k-n is a window old.
  Both are rising functions of a place in the log, so a chunk is linear over (max, composition): what follows from any
  state is the maximum, place by place, of the ``n`` runs that each start where one of the slots is free again and
  know nothing else, the i-th of them i passes later.
* Hence a chunk is told by such runs alone: for every row of its first window, how many passes the run has that starts
  there, and the last of them. Runs are found for all rows at once.
* Functions of neighbouring chunks compose to one of the same kind, FAN at a time, in as many rounds as the tree is high; states
  then go down the tree, and all chunks are replayed at once from their own states.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plazalens.session import durable

#: Chunks that are composed in one task.
FAN = 16
#: Rows of a key's log that are one chunk, whatever time they span.
SMALL_LOG = 1 << 16
#: The time of a pass that never was.
NEVER = -(1 << 60)

OUTCOME = "_limit bigint, _window bigint, entries array<bigint>, passes array<bigint>, last array<bigint>"


def replay(times: list, limit: int, window: float, passed: deque) -> list[bool]:
    """Which of the rising times pass after those of ``passed``, which is carried on. Rows between
    two passes are skipped, not walked."""
    out = [False] * len(times)
    at = 0
    while at < len(times):
        if len(passed) >= limit:
            at = max(at, bisect_left(times, passed[-limit] + window)) if limit else len(times)
        if at < len(times):
            out[at] = True
            passed.append(times[at])
            if len(passed) > limit:
                passed.popleft()
            at += 1
    return out


class Outcome:
    """What a stretch of time does to any state: for each row at which a slot may be free first, the
    passes of the run that starts there, and the last ``depth`` of them, NEVER where there are fewer."""

    def __init__(self, entries: np.ndarray, passes: np.ndarray, last: np.ndarray):
        self.entries, self.passes, self.last = entries, passes, last

    @classmethod
    def of(cls, times: np.ndarray, limit: int, window: int, begin: int, depth: int) -> Outcome:
        n = len(times)
        many = min(n, int(np.searchsorted(times, begin + window)) + 1)
        freed = np.append(np.searchsorted(times, times + window), n)
        ring = np.full((depth, many), n)
        place, passes, m = np.arange(many), np.zeros(many, np.int64), 0
        alive = place < n
        while alive.any():
            ring[m % depth, alive] = place[alive]
            passes += alive
            m += 1
            following = np.maximum(place + 1, freed[ring[(m - limit) % depth]]) if m >= limit else place + 1
            place = np.where(alive, np.minimum(following, n), n)
            alive = place < n
        number = passes[:, None] - depth + np.arange(depth)
        kept = ring[number % depth, np.arange(many)[:, None]]
        last = np.where(number >= 0, np.append(times, NEVER)[kept], NEVER)
        return cls(times[:many], passes, last)

    @classmethod
    def read(cls, row: dict) -> Outcome:
        entries, passes, last = (np.asarray(row[c], np.int64) for c in ("entries", "passes", "last"))
        return cls(entries, passes, last.reshape(len(entries), -1))

    def columns(self) -> dict[str, list]:
        return {"entries": self.entries.tolist(), "passes": self.passes.tolist(), "last": self.last.reshape(-1).tolist()}

    def after(self, earlier: np.ndarray, limit: int, window: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """For states given by their last passes (a row each): the passes here, and the last ``wanted`` of all."""
        passes = np.append(self.passes, 0)  # a slot that is free after the last row starts no run
        last = np.concatenate([self.last, np.full((1, self.last.shape[1]), NEVER)])
        depth = last.shape[1]
        first = np.searchsorted(self.entries, earlier[:, -limit:] + window)
        total = (passes[first] + np.arange(limit)).min(1)
        number = total[:, None] - wanted + np.arange(wanted)
        out = np.full(number.shape, NEVER)
        for i in range(limit):
            run = first[:, i][:, None]
            back = passes[run] - (number - i)  # 1 is the run's last pass
            told = (number >= i) & (back >= 1) & (back <= depth)
            out = np.maximum(out, np.where(told, last[run, np.where(told, depth - back, 0)], NEVER))
        before = earlier.shape[1] + number
        old = np.take_along_axis(earlier, np.clip(before, 0, earlier.shape[1] - 1), 1)
        return total, np.where(number >= 0, out, np.where(before >= 0, old, NEVER))

    def then(self, later: Outcome, limit: int, window: int, wanted: int) -> Outcome:
        """The outcome of this stretch, at least a window long, and the next one. A slot that is free
        only after the last row here meets the first one there."""
        more, last = later.after(self.last, limit, window, wanted)
        entries, passes = np.append(self.entries, later.entries[0]), np.append(self.passes + more, later.passes[0])
        return Outcome(entries, passes, np.concatenate([last, later.last[:1, -wanted:]]))


def _depth(limit: int, levels: int) -> int:
    """Passes that a run tells: three times the limit where states pass, and two more for each composition above."""
    return limit * (3 + 2 * levels)


def _heads(batch: pa.RecordBatch, before: int | None) -> list[int]:
    """Where a new chunk begins in a sorted batch, by the hash of its key."""
    runs = np.array(batch.column("_run"), np.int64)
    new = np.concatenate([[before is None or runs[0] != before], runs[1:] != runs[:-1]])
    return np.flatnonzero(new).tolist()


def _outcomes(group: list[str], levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each chunk of a sorted partition."""

    def made(fields: list[pa.Field], rows: list[tuple[dict, list]]) -> pa.RecordBatch:
        found = [Outcome.of(np.concatenate(t), r["_limit"], r["_window"], r["_begin"], _depth(r["_limit"], levels)).columns() for r, t in rows]
        columns = [pa.array([r[f.name] for r, _ in rows], f.type) for f in fields]
        columns += [pa.array([f[c] for f in found], pa.list_(pa.int64())) for c in ("entries", "passes", "last")]
        return pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), "entries", "passes", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict, list]] = []
        last = None
        fields: list[pa.Field] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = _heads(batch, last)
            last = batch.column("_run")[-1].as_py()
            fields = [batch.schema.field(c) for c in (*group, "_limit", "_window")]
            times = np.array(batch.column("_us"), np.int64)
            if held and (not heads or heads[0]):
                held[-1][1].append(times[: heads[0] if heads else None])
            begun = batch.select([*group, "_limit", "_window", "_begin"]).take(pa.array(heads, pa.int64())).to_pylist()
            for row, a, b in zip(begun, heads, [*heads[1:], len(times)]):
                held.append((row, [times[a:b]]))
            if len(held) > 1:
                yield made(fields, held[:-1])
                held = held[-1:]
        if held:
            yield made(fields, held)

    return run


def _composed(names: list[str], level: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One outcome from those of a block's chunks, whose numbers are in the last of ``names``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(names[-1], ignore_index=True)
        limit, window = int(rows["_limit"][0]), int(rows["_window"][0])
        wanted = _depth(limit, levels - level)
        whole = Outcome.read(rows.iloc[0])
        for i in range(1, len(rows)):
            whole = whole.then(Outcome.read(rows.iloc[i]), limit, window, wanted)
        whole.last = whole.last[:, -wanted:]
        out = rows.iloc[:1][[*names, "_limit", "_window"]].copy()
        out[names[-1]] = out[names[-1]] // FAN
        for c, v in whole.columns().items():
            out[c] = [v]
        return out

    return run


def _handed_down(names: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The state at the begin of each chunk of a block, from the state at the block's begin."""

    def run(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        out = rows.sort_values(names[-1], ignore_index=True)
        if not len(out):
            return pd.DataFrame({**{c: [] for c in names}, "_state": []})
        limit, window = int(out["_limit"][0]), int(out["_window"][0])
        state = np.full((1, limit), NEVER)
        if len(states):
            state[:] = states["_state"].iat[0]
        found = []
        for i in range(len(out)):
            found.append(state[0].tolist())
            if i < len(out) - 1:
                _, state = Outcome.read(out.iloc[i]).after(state, limit, window, limit)
        out = out[names].copy()
        out["_state"] = found
        return out

    return run


def _replayed(out: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walk one sorted partition; a chunk's state comes before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, passed = None, deque()
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = _heads(batch, last)
            last = batch.column("_run")[-1].as_py()
            times, flags = batch.column("_us").to_pylist(), []
            states, limits, windows = (batch.column(c) for c in ("_state", "_limit", "_window"))
            begins = set(heads)
            for a, b in zip([0, *heads], [*heads, len(times)]):
                if a == b:
                    continue
                if a in begins:
                    passed = deque()
                if states[a].is_valid:
                    passed = deque(t for t in states[a].as_py() if t > NEVER)
                    flags.append(False)
                    a += 1
                if a < b:
                    flags += replay(times[a:b], limits[a].as_py(), windows[a].as_py(), passed)
            columns = [*(batch.column(c) for c in out), pa.array(flags, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*out, "admitted"]).filter(states.is_null())

    return run


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r{k}"]) for k in names])


def busy_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that hold more rows than their limit in two neighbouring cells of one window, with all their rows; a key's
    cells are counted map side and as many as it has windows."""
    cells = rows.groupBy(*keys, F.floor(F.col("_us") / F.col("_window")).alias("_cell")).agg(F.count("*").alias("_n"), F.first("_limit").alias("_limit"))
    two = F.sum("_n").over(W.partitionBy(*keys).orderBy("_cell").rangeBetween(-1, 0))
    counted = cells.withColumn("_busy", two > F.col("_limit")).groupBy(*keys).agg(F.max("_busy").alias("_busy"), F.sum("_n").alias("_rows"))
    return counted.filter("_busy").select(*[F.col(k).alias(f"_r{k}") for k in keys], (F.col("_rows") > SMALL_LOG).alias("_large"))


def chunk_states(walked: DataFrame, keys: list[str], sorted_rows: DataFrame) -> DataFrame:
    """(keys, _chunk, _state): the last passes before each chunk that is not a key's first."""
    group = [*keys, "_chunk"]
    kinds = {f.name: f.dataType.simpleString() for f in walked.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in group)
    span = walked.agg(F.min("_chunk"), F.max("_chunk")).first()
    base, span = (span[0] or 0), (span[1] or 0) - (span[0] or 0)
    levels = 0
    while FAN**levels <= span:
        levels += 1
    if levels == 0:
        return walked.select(*group, F.lit(None).cast("array<bigint>").alias("_state")).limit(0)
    tables = sorted_rows.mapInArrow(_outcomes(group, levels - 1), f"{schema}, {OUTCOME}")
    tables = [durable(tables.withColumn("_chunk", F.col("_chunk") - base))]
    parent = F.floor(F.col("_chunk") / FAN).cast("long").alias("_parent")
    for level in range(1, levels):
        tables.append(durable(tables[-1].groupBy(*keys, parent).applyInPandas(_composed(group, level, levels - 1), f"{schema}, {OUTCOME}")))
    states = walked.select(*group, F.lit(None).cast("array<bigint>").alias("_state")).limit(0)
    for rows in reversed(tables):
        above = states.select(*keys, F.col("_chunk").alias("_parent"), "_state")
        states = rows.groupBy(*keys, parent).cogroup(above.groupBy(*keys, "_parent")).applyInPandas(_handed_down(group), f"{schema}, _state array<bigint>")
    return states.withColumn("_chunk", F.col("_chunk") + base)


def admit(
    log: DataFrame,
    keys: list[str],
    ts: str,
    order: list[str],
    limit: Column,
    window: Column,
    chunk_seconds: int = 86_400,
) -> DataFrame:
    """Add the boolean ``admitted``. ``limit`` and ``window`` (seconds) are constant per key."""
    rows = (
        log.withColumn("_us", F.unix_micros(ts))
        .withColumn("_limit", limit.cast("long"))
        .withColumn("_window", F.round(window.cast("double") * 1_000_000).cast("long"))
        .withColumn("_size", F.greatest(F.lit(chunk_seconds * 1_000_000).cast("long"), 2 * F.col("_window")))
    )
    busy = durable(busy_keys(rows, keys))
    quiet = rows.join(busy, _same(rows, busy, keys), "left_anti").select(*log.columns, F.lit(True).alias("admitted"))
    walked = rows.join(busy, _same(rows, busy, keys)).drop(*[f"_r{k}" for k in keys])
    walked = walked.withColumn("_chunk", F.when(F.col("_large"), F.floor(F.col("_us") / F.col("_size"))).otherwise(0).cast("long"))
    group = [*keys, "_chunk"]
    run = F.xxhash64(*group).alias("_run")
    # A key without any slot refuses all; its chunks say nothing, so that they may be told as if it had one.
    both = walked.select(*log.columns, "_us", "_limit", "_window", "_chunk", F.lit(None).cast("array<bigint>").alias("_state"))
    if not busy.filter("_large").isEmpty():
        large = walked.filter("_large")
        needed = large.select(*group, run, "_us", F.greatest("_limit", F.lit(1)).alias("_limit"), "_window", (F.col("_chunk") * F.col("_size")).alias("_begin"))
        states = chunk_states(large, keys, needed.repartition(*group).sortWithinPartitions(*group, "_us"))
        both = both.unionByName(states.withColumn("_us", F.lit(0).cast("long")), allowMissingColumns=True)
    both = both.withColumn("_run", run)
    both = both.repartition(*group).sortWithinPartitions(*group, F.col("_state").isNull(), "_us", *order)
    schema = T.StructType([*log.schema.fields, T.StructField("admitted", T.BooleanType())])
    return both.mapInArrow(_replayed(log.columns), schema).unionByName(quiet)
