"""Replay of the stored ledger through named consumers: a work list of slices that can stop and be taken up again.

A consumer is a function of a slice of the ledger and its bounds, and is to be one that may run again: it replaces what it wrote for the slice. What
each consumer has done is a pointer beside the ledger, moved after every slice, so a run that ends anywhere goes on at the
slice that wasn't finished. No cursor is read or moved. Slices are block ranges and their number follows from the width.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import files
from .chain import replay_plan
from .ledger import in_range


def replay(
    ledger: DataFrame, work: str, chain: int, lo: int, hi: int, width: int, safe: int, consumers: dict[str, Callable], only: tuple | None = None, dry_run: bool = False, stop: Callable = lambda: False
) -> DataFrame | dict:
    """Run the consumers, or those named in ``only``, over the settled blocks from ``lo`` to ``hi``; returns per consumer the block to resume from.

    Unknown names, empty ranges and blocks above ``safe`` are refused before anything runs. ``dry_run`` returns the slices.
    ``work`` is the pointer of this replay; one made for other bounds is refused. ``stop`` is asked before every slice.
    """
    names = tuple(consumers) if only is None else tuple(only)
    unknown = sorted(set(names) - set(consumers))
    if unknown or not names:
        raise ValueError(f"unknown consumers {unknown}, there are {sorted(consumers)}")
    spark: SparkSession = ledger.sparkSession
    plan = replay_plan(spark, lo, hi, width, safe)
    if dry_run:
        return plan
    bounds = {"chain": chain, "lo": lo, "hi": hi, "width": width}
    state = files.pointer(spark, work) or {**bounds, "next": {}}
    if {k: state[k] for k in bounds} != bounds:
        raise ValueError(f"{work} is the work list of another replay")
    for name in names:
        at = state["next"].get(name, lo)
        while at <= hi and not stop():
            end = min(at + width - 1, hi)
            consumers[name](ledger.where(in_range(chain, at, end)), at, end)
            at = end + 1
            state["next"][name] = at
            files.publish(spark, work, state)
    return {name: state["next"].get(name, lo) for name in names}
