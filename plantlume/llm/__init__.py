"""Operators of training-data pipelines; nothing else in the library imports this package."""


def queries() -> dict:
    from corpus_pipeline import run

    from .registered import QUERIES

    return {**QUERIES, "pipeline": run}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
