"""What a plan does once for each row, read off the plan: costs that only show on large tables."""

from posledger.operators import folds
from posledger.plans import kept, pools, upkeep

DATA = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_the_fault_parses_a_body_once(spark):
    df = folds.sound(kept._spoilt(spark, DATA)).select("block_number")
    assert _plan(df).count("from_json") == 1


def test_both_contracts_are_decoded_in_one_pass(spark):
    assert _plan(upkeep._decoded(spark, DATA)).count("_numbers(") == 1


def test_a_row_carries_on_the_sums_of_its_own_scale_only(spark):
    pool = _plan(pools._pool(spark, DATA))
    assert pool.count("sum(") == len(folds.ASSET_SUMS) + 3  # and events by scale, events in all, the signs of live rows
