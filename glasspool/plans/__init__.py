"""The analyses a user asks for, each a lazy DataFrame over a `Ledger`."""
