"""All registered queries of the engine with their DuckDB equivalents."""

from . import corpora, ledgers, retrieval, tables, upkeep, vault

#: Queries over the files that stand in `corpora`, where the same operator runs over the tables: tests run these, nothing registers them.
TWINS = {
    "catalog_rows": "ledger_catalog", "decision_rows": "ledger_decisions", "session_log_entries": "ledger_sessions", "status_sections": "ledger_status", "idea_routes": "ledger_ideas", "run_log_rows": "ledger_runs",
    "registry_rows": "registry_written", "registry_search": "federated_hits", "registry_totals": "federated_totals", "registry_edited": "registry_kept", "stale_texts": "stale_parts", "redundant_pairs": "redundant_orders",
    "workspace_states": "customer_states", "override_pairs": "decision_overrides", "decision_clusters": "week_clusters", "idempotent_write": "session_end_rows", "facet_entry": "facet_entries", "facet_dates_turns": "facet_dates",
    "facet_people_turns": "facet_people", "strategy_names": "strategies",
} | {k: f"vault_{k}" for k in corpora.QUERIES if f"vault_{k}" in vault.QUERIES}

_ALL = {**retrieval.QUERIES, **tables.QUERIES, **corpora.QUERIES, **vault.QUERIES, **upkeep.QUERIES, **ledgers.QUERIES}
_SQL = {**retrieval.ORACLES, **tables.ORACLES, **corpora.ORACLES, **vault.ORACLES, **upkeep.ORACLES, **ledgers.ORACLES}
QUERIES = {k: q for k, q in _ALL.items() if k not in TWINS}
ORACLES = {k: s for k, s in _SQL.items() if k in QUERIES}
#: What only tests run.
HAND_QUERIES = {k: _ALL[k] for k in TWINS}
HAND_ORACLES = {k: _SQL[k] for k in TWINS if k in _SQL}
