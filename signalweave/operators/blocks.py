"""Series cut into blocks, so that many tasks work on one channel.

A series of any length is dealt into blocks of about ``SAMPLES`` samples; no task, window or group sees all of it. What goes over the
edges of blocks is small: halos of neighbouring samples (:func:`with_halo`), or summaries of whole blocks that a scan
turns into the state at the start of each (:func:`carried`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import placed, stored
from ..model import keys_of, per_series

#: Samples of a block.
SAMPLES = 1 << 14
#: Block summaries that one step of a scan takes together.
SCAN = 1024
#: Series whose lengths are sent to all tasks; more are joined by a shuffle (and then most are short).
BROADCAST_SERIES = 100_000


@dataclass(frozen=True)
class Grid:
    """Blocks of ``size`` samples, the last one of a series up to twice as many; a shorter series is one block."""

    size: int

    def last(self, n: int) -> int:
        return max(n // self.size - 1, 0)

    def own(self, block: int, n: int) -> tuple[int, int]:
        """First position of a block without its halo, and the one after its last."""
        return block * self.size, n if block == self.last(n) else (block + 1) * self.size


@dataclass(frozen=True)
class Cut:
    """Blocks of series. ``table``: keys, n (length of the series), missing (whether it has a missing value), block (from 0), at (0-based position of the first value), values.

    ``halo`` samples of the neighbours come before and after those of a block.
    """

    keys: list[str]
    table: DataFrame
    grid: Grid
    halo: int


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join by columns of which nulls are equal."""
    other = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(other, same, how).drop(*[f"_on_{c}" for c in on])


def lengths(signals: DataFrame) -> tuple[DataFrame, int, bool]:
    """keys, _low (first sample), n, missing; the length of the longest series, and whether all are numbered without gaps."""
    keys, value = keys_of(signals), F.col("value" if "value" in signals.columns else "re")
    gone = F.coalesce(F.max(value.isNull() | F.isnan(value)), F.lit(False))
    found = signals.groupBy(*keys).agg(F.min("sample").alias("_low"), F.max("sample").alias("_high"), F.count("*").alias("n"), gone.alias("missing"))
    found = stored(found, "lengths")
    most, even = found.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.min(F.col("_high") - F.col("_low") + 1 == F.col("n")), F.lit(True))).first()
    return found.drop("_high"), most, even


def in_one_block(found: tuple[DataFrame, int, bool]) -> bool:
    """Whether all series are shorter than two blocks; then each is worked on where it is gathered."""
    return found[1] < 2 * SAMPLES


def cut(signals: DataFrame, found: tuple[DataFrame, int, bool], size: int | None = None, halo: int = 0) -> Cut:
    """The blocks of all series, stored; ``found`` are their :func:`lengths`. Samples are taken in order, whatever their numbers. The halo is at most a block."""
    known, _, even = found
    size = size or SAMPLES
    keys = keys_of(signals)
    by = keys or ["_series"]
    few = known.count() <= BROADCAST_SERIES
    rows, known = (signals, known) if keys else (signals.withColumn("_series", F.lit(0)), known.withColumn("_series", F.lit(0)))
    rows = meet(rows, F.broadcast(known) if few else known, by)
    if even:
        rows = rows.withColumn("_at", F.col("sample") - F.col("_low"))
    else:
        rows = placed(rows, [F.col("sample")], by, "_at")
    mine, end = F.floor(F.col("_at") / F.lit(size)), F.greatest(F.floor(F.col("n") / F.lit(size)) - 1, F.lit(0))
    mine = F.least(mine, end)
    spots = [mine]
    if halo:
        spots += [F.when((mine > 0) & (F.col("_at") - mine * size < halo), mine - 1), F.when((mine < end) & ((mine + 1) * size - F.col("_at") <= halo), mine + 1)]
    rows = rows.withColumn("block", F.explode(F.array_compact(F.array(*spots))))
    ordered = F.array_sort(F.collect_list(F.struct("_at", F.col("value").cast("double").alias("value"))))
    table = rows.groupBy(*by, "block", "n", "missing").agg(F.min("_at").alias("at"), F.transform(ordered, lambda x: x["value"]).alias("values"))
    return Cut(by, stored(table, "blocks"), Grid(size), halo)


def kinds_of(table: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in columns)


def each(table: DataFrame, fn: Callable[[pd.Series], dict | None], keep: list[str], out: str) -> DataFrame:
    """``fn`` of every row; its result (scalars and lists, or none) with the columns ``keep`` before it."""
    names = [c.strip().split(" ")[0].strip("`") for c in out.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                found = fn(row)
                if found is not None:
                    yield pd.DataFrame({c: [row[c]] for c in keep} | {c: [found[c]] for c in names})

    return table.mapInPandas(run, f"{kinds_of(table, keep)}, {out}")


def spread(table: DataFrame, fn: Callable[[pd.Series], dict[str, np.ndarray]], keys: list[str], out: str) -> DataFrame:
    """Rows made of every block: ``fn`` returns arrays for the columns ``out``; keys come before them (a stand-in key goes)."""
    keys = [k for k in keys if k != "_series"]
    names = [c.strip().split(" ")[0] for c in out.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                found = fn(row)
                size = len(found[names[0]])
                if size:
                    yield pd.DataFrame({k: [row[k]] * size for k in keys} | {c: found[c] for c in names})

    kinds = kinds_of(table, keys)
    return table.mapInPandas(run, f"{kinds}{', ' if kinds else ''}{out}")


# ---------------------------------------------------------------- convolutions
def with_halo(signals: DataFrame, halo: int, whole: Callable[[np.ndarray], np.ndarray | dict], part: Callable[[np.ndarray, bool, bool, int, int], np.ndarray | dict], out: str = "value double", spreads: bool = False) -> DataFrame:
    """An operator whose output at a sample needs ``halo`` samples on both sides.

    ``whole`` gets a whole series that fits one block. ``part`` gets a block with its halos, whether it is the first and the last of its series, and the range of its own
    samples in the array; it returns values for these. With ``spreads`` a missing value makes all of a series missing.
    """
    size = max(SAMPLES, 2 * halo)
    found = lengths(signals)
    if found[1] < 2 * size:
        return per_series(signals, whole, out)
    blocks = cut(signals, found, size, halo)
    grid = blocks.grid
    names = [c.strip().split(" ")[0] for c in out.split(",")]

    def run(row: pd.Series) -> dict[str, np.ndarray]:
        x = np.array(row["values"], np.float64)
        first, end = grid.own(row["block"], row["n"])
        if spreads and row["missing"]:
            x = np.full(x.size, np.nan)
        alone = first == 0 and end == row["n"]
        got = whole(x) if alone else part(x, first == 0, end == row["n"], first - row["at"], end - row["at"])
        got = got if isinstance(got, dict) else {names[0]: got}
        if "at" in got:
            got["at"] = got["at"] + first
        return {"sample": np.arange(first + 1, first + 1 + len(got[names[0]]))} | got

    return spread(blocks.table, run, blocks.keys, f"sample long, {out}")


def convolve(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Full convolution, by the FFT where it is the cheaper one and nothing is missing."""
    if kernel.size < 64 or np.isnan(x).any():
        return np.convolve(x, kernel)
    size = 1 << (x.size + kernel.size - 2).bit_length()
    made = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(kernel, size))[: x.size + kernel.size - 1]
    return made if np.iscomplexobj(kernel) else made.real


# ---------------------------------------------------------------- recursions
def carried(summaries: DataFrame, keys: list[str], power: Callable[[int], np.ndarray], blocks: int) -> DataFrame:
    """keys, block, state: the state in which each block starts.

    ``summaries``: keys, block (0 to ``blocks`` - 1 at most), m (its samples), made (the state at its end if it started from zero), start (the state of block 0).
    A block is the affine map ``state -> power(m) @ state + made``. Maps compose, so runs of ``SCAN`` blocks become one block each, and so on, until one run is left;
    the states then go down again.
    """
    kinds = kinds_of(summaries, keys)

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        made = np.zeros(len(frame["made"].iloc[0]))
        for m, own in zip(frame["m"], frame["made"], strict=True):
            made = power(int(m)) @ made + own
        return pd.DataFrame({k: [frame[k].iloc[0]] for k in keys} | {"block": [frame["block"].iloc[0] // SCAN], "m": [frame["m"].sum()], "made": [made.tolist()], "start": [frame["start"].iloc[0]]})

    def unroll(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        state, states = np.array(frame["start"].iloc[0], float), []
        for m, own in zip(frame["m"], frame["made"], strict=True):
            states.append(state.tolist())
            state = power(int(m)) @ state + own
        return pd.DataFrame({k: frame[k].to_numpy() for k in keys} | {"block": frame["block"].to_numpy(), "state": states})

    run = F.floor(F.col("block") / F.lit(SCAN))
    if blocks > SCAN:
        above = summaries.groupBy(*keys, run.alias("_run")).applyInPandas(compose, f"{kinds}, block long, m long, made array<double>, start array<double>")
        above = carried(above, keys, power, -(-blocks // SCAN)).withColumnRenamed("block", "_run")
        summaries = meet(summaries.withColumn("_run", run).drop("start"), above.withColumnRenamed("state", "start"), [*keys, "_run"])
        return summaries.groupBy(*keys, "_run").applyInPandas(unroll, f"{kinds}, block long, state array<double>")
    return summaries.groupBy(*keys).applyInPandas(unroll, f"{kinds}, block long, state array<double>")


#: Exit of a step function where a block leaves its state as it is; states are positions, so never negative.
UNCHANGED = -1


def stepped(summaries: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """keys, block, state: the position in which each block starts; that of block 0 is 0.

    ``summaries``: keys, block (0 to ``blocks`` - 1 at most), bounds (ascending), exits (one more than bounds). A block turns a state into the exit of its first bound that
    is not below the state (the last exit beyond all bounds). Runs of ``SCAN`` blocks compose to one step function, as in :func:`carried`.
    """
    return _stepped(summaries.withColumn("start", F.lit(0).cast("long")), keys, blocks)


def _step(states: np.ndarray, bounds: np.ndarray, exits: np.ndarray) -> np.ndarray:
    made = np.asarray(exits, np.int64)[np.searchsorted(np.asarray(bounds, np.int64), states)]
    return np.where(made == UNCHANGED, states, made)


def _stepped(summaries: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    kinds = kinds_of(summaries, keys)

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        exits = np.asarray(frame["exits"].iloc[0], np.int64)
        for bounds, following in zip(frame["bounds"].iloc[1:], frame["exits"].iloc[1:], strict=True):
            exits = _step(exits, bounds, following)
        head = {k: [frame[k].iloc[0]] for k in keys}
        return pd.DataFrame(head | {"block": [frame["block"].iloc[0] // SCAN], "bounds": [list(frame["bounds"].iloc[0])], "exits": [exits.tolist()], "start": [frame["start"].iloc[0]]})

    def unroll(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        state, states = np.array([frame["start"].iloc[0]]), []
        for bounds, exits in zip(frame["bounds"], frame["exits"], strict=True):
            states.append(int(state[0]))
            state = _step(state, bounds, exits)
        return pd.DataFrame({k: frame[k].to_numpy() for k in keys} | {"block": frame["block"].to_numpy(), "state": states})

    run = F.floor(F.col("block") / F.lit(SCAN))
    if blocks > SCAN:
        above = summaries.groupBy(*keys, run.alias("_run")).applyInPandas(compose, f"{kinds}, block long, bounds array<long>, exits array<long>, start long")
        above = _stepped(above, keys, -(-blocks // SCAN)).withColumnRenamed("block", "_run")
        summaries = meet(summaries.withColumn("_run", run).drop("start"), above.withColumnRenamed("state", "start"), [*keys, "_run"])
        return summaries.groupBy(*keys, "_run").applyInPandas(unroll, f"{kinds}, block long, state long")
    return summaries.groupBy(*keys).applyInPandas(unroll, f"{kinds}, block long, state long")
