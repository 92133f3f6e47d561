"""Labels of rows that pair an output address set with an input address set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glasspool.functions.arrays import first_address, first_address_or_blank


def row_label(output_address: Column, input_address: Column) -> Column:
    """The output address, or the input address when that is empty or missing."""
    return F.coalesce(F.nullif(output_address, F.lit("")), input_address)


def stitched_address(input_addresses: Column, output_addresses: Column) -> Column:
    """The address both sides agree on, or that of the only side present; null if they differ."""
    both_equal = (
        input_addresses.isNotNull()
        & output_addresses.isNotNull()
        & input_addresses.eqNullSafe(output_addresses)
    )
    return (
        F.when(both_equal, first_address(input_addresses))
        .when(output_addresses.isNull(), first_address(input_addresses))
        .when(input_addresses.isNull(), first_address_or_blank(output_addresses))
    )
