"""Named queries over the standard tables, each with the SQL that states its result."""


def load() -> tuple[dict, dict]:
    """Queries and their SQL, by name."""
    from folioscope.plans import analytics, bounded, calls, pairs, registry, retrieval, surface, upkeep, writing

    assert analytics and bounded and calls and pairs and retrieval and surface and upkeep and writing
    return dict(registry.QUERIES), dict(registry.ORACLES)
