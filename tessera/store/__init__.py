"""Versioned tables, transactions, and the engine that runs statements on them."""
