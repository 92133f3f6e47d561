"""Analytics over a UTXO ledger with a shielded value pool, as Spark DataFrame plans."""

from glasspool.ledger import Ledger
from glasspool.settings import Settings
from glasspool.workspace import Workspace

__all__ = ["Ledger", "Settings", "Workspace"]
