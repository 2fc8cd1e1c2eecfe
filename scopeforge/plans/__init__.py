"""Query plans: the registry of named queries (DataFrame builders) and their SQL oracles."""
