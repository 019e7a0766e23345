"""Part of pairlens."""
