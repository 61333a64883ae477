"""All oracle SQL, keyed like orderlens.registry.QUERIES."""

from oracle.adapter import with_tables

SHARE_QUERIES: set = set()


def oracle_queries() -> dict[str, str]:
    from oracle import sql_rfv
    modules = [sql_rfv]
    for name in ("sql_products", "sql_trends", "sql_inactivity", "sql_divergence", "sql_dashboard",
                 "sql_sharing", "sql_lineage", "sql_quality", "sql_sources", "sql_text", "sql_misc"):
        try:
            modules.append(__import__(f"oracle.{name}", fromlist=["SQL"]))
        except ImportError:
            pass
    out = {}
    for m in modules:
        shares = getattr(m, "NEEDS_SHARES", set())
        for k, body in m.SQL.items():
            out[k] = with_tables(body, shares=k in shares)
    return out
