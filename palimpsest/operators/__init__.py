"""DataFrame operators built on :mod:`palimpsest.functions`."""
