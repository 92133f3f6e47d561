"""Analysis parameters. Every default is a fixed value of the ledger or of the published analysis."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

# Fixed values.
GENESIS_TX = "c4eaa58879081de3c24a7b117ed2b28300e7ec4c4c1dff1d3f1268b7857a4ddb"
FOUNDER_DEPOSIT = Decimal("249.9999")
FOUNDER_WITHDRAWAL = Decimal("250.0001")
FOUNDERS_REWARD = Decimal("2.5")
MINER_DESTINATIONS = 100
SUMMARY_TOPS = (5, 10, 25, 50, 100)
CONCENTRATION_TOPS = (5, 10, 25, 30)
RICH_LIST_SIZE = 10
CLUSTER_TOP_ADDRESSES = 5


@dataclass(frozen=True)
class Settings:
    """Amounts, thresholds and list sizes used by the heuristics and reports."""

    founder_deposit: Decimal = FOUNDER_DEPOSIT
    founder_withdrawal: Decimal = FOUNDER_WITHDRAWAL
    founders_reward: Decimal = FOUNDERS_REWARD
    miner_destinations: int = MINER_DESTINATIONS

#: Blocks an address may be silent within one stretch of activity.
ACTIVE_GAP = 30
