"""All registered queries of the library and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


#: Queries that stop early or work on a fixed list, as their SQL does, and the query that does the whole job.
CUT = {
    "j8_replace_list": "j8_replace_list_whole", "k14_relabel": "k14_relabel_words", "e8_fallback_lookup": "e8_fallback_lookup_all",
    "g1_default_order": "g1_default_order_all", "g2_chosen_order": "g2_chosen_order_all", "g5_waiting_list_desc": "g5_waiting_list_desc_all",
    "g6_waiting_list_asc": "g6_waiting_list_asc_all", "g7_invalid_last": "g7_invalid_last_all", "g8_pinned_first": "g8_pinned_first_all",
    "e16_list_membership": "e16_list_membership_rows", "k5_array_upper": "k5_array_upper_words", "c13_invalid_pattern": "c13_regex_search",
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `name`, with its SQL twin if it has one."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _load() -> None:
    """Import the modules that register queries."""
    from plenum.plans import decisions, lifecycle, live, relational, scalars, speech, streams  # noqa: F401


_load()
