"""The jobs as queries over whole tables, and the same in DuckDB SQL."""

from __future__ import annotations

from jobs import context_packs, term_index


def queries() -> dict:
    return {"job1_term_index": term_index.job1_term_index, "job2_context_packs": context_packs.job2_context_packs}


def oracle_sql() -> dict[str, str]:
    return {"job1_term_index": term_index.SQL, "job2_context_packs": context_packs.SQL}
