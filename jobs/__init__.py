"""Runnable jobs: `python -m jobs.term_index CONFIG` and `python -m jobs.context_packs CONFIG`. Each is also a query over whole tables."""
