"""Transaction types and the flags derived from which legs a transaction has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glasspool.functions.arrays import no_addresses

# The closed vocabulary of transaction types.
MINER_REWARD = "minerReward"
PUBLIC = "public"
SHIELDED = "shielded"
DESHIELDED = "deshielded"
PRIVATE = "private"
MIXED = "mixed"
UNKNOWN = "UNKNOWN"

TYPES = (MINER_REWARD, PUBLIC, SHIELDED, DESHIELDED, PRIVATE, MIXED, UNKNOWN)


def transaction_type(
    vin_count: Column, vout_count: Column, joinsplit_count: Column, coinbase_count: Column
) -> Column:
    """Type by the legs present; a transaction whose only input is a coinbase is a reward."""
    pays_in, pays_out, joins = vin_count > 0, vout_count > 0, joinsplit_count > 0
    return (
        F.when((vin_count == 1) & (coinbase_count == 1), MINER_REWARD)
        .when(pays_in & pays_out & joins, MIXED)
        .when(pays_in & pays_out, PUBLIC)
        .when(pays_in & joins, SHIELDED)
        .when(pays_out & joins & ~pays_in, DESHIELDED)
        .when(joins & ~pays_in, PRIVATE)
        .otherwise(UNKNOWN)
    )


def from_joinsplit(vin_count: Column, joinsplit_count: Column) -> Column:
    """Whether outputs can only be paid by the pool: joinsplits and no inputs."""
    return (joinsplit_count > 0) & (vin_count == 0)


def raw_destination(
    vin_count: Column, vout_count: Column, vpub_new: Column, output_addresses: Column
) -> Column:
    """Destinations known before enrichment: the outputs of a transaction fed by the pool alone."""
    pays_out = (vout_count > 0) & (vin_count == 0) & (vpub_new > 0)
    return F.when(pays_out, output_addresses).otherwise(no_addresses())
