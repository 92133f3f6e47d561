"""The six clean tables, bundled."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from glasspool import schema


@dataclass(frozen=True)
class Ledger:
    """Six lazy DataFrames; see `glasspool.schema` for their columns.

    `vin` carries the address set and value of the output it spends (`vi_address`, `vi_value`)
    once `operators.inputs.resolve_inputs` has run.
    """

    transaction: DataFrame
    block: DataFrame
    coingen: DataFrame
    vin: DataFrame
    vout: DataFrame
    vjoinsplit: DataFrame

    @classmethod
    def names(cls) -> list[str]:
        return [field.name for field in fields(cls)]

    @classmethod
    def empty(cls, spark: SparkSession) -> Ledger:
        return cls(**{name: spark.createDataFrame([], schema.CLEAN[name]) for name in cls.names()})

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.names()}

    def append(self, other: Ledger) -> Ledger:
        """Every row of both ledgers (UNION ALL per table)."""
        return Ledger(
            **{
                name: table.unionByName(getattr(other, name))
                for name, table in self.tables().items()
            }
        )

    def with_tables(self, **tables: DataFrame) -> Ledger:
        return replace(self, **tables)
