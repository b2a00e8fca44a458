"""The query catalogue: one Spark builder and (where SQL can state it) one DuckDB oracle
per operator of the inventory. Every query reads the driver's tables at ``sf_dir``."""
from __future__ import annotations

from tillage.catalog import q_eval, q_model, q_profile, q_scalar


def catalogue() -> dict:
    return {**q_profile.QUERIES, **q_scalar.QUERIES, **q_eval.QUERIES, **q_model.QUERIES}
