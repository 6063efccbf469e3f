"""The registered ledger queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that must give the same rows."""

from .plans import instants, kept, pools, positions, upkeep

QUERIES: dict = {**positions.QUERIES, **pools.QUERIES, **upkeep.QUERIES, **kept.QUERIES, **instants.QUERIES}
ORACLES: dict = {**positions.ORACLES, **pools.ORACLES, **upkeep.ORACLES, **kept.ORACLES, **instants.ORACLES}
