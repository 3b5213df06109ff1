"""Independent SQL texts for DuckDB, one per registered query where SQL can express it."""

from __future__ import annotations


def all_oracles() -> dict[str, str]:
    from oracle import dashboards, mining, operators, shop

    return {**dashboards.ORACLES, **mining.ORACLES, **operators.ORACLES, **shop.ORACLES}
