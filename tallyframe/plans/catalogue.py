"""All queries outside the llm subpackage, by name, with the SQL that checks them."""

from __future__ import annotations

from tallyframe.plans import problems, reference, runs, scores


def queries():
    return {**reference.Q, **scores.Q, **runs.Q, **problems.QUERIES}


def oracle_sql():
    return {**reference.SQL, **scores.SQL, **runs.SQL, **problems.oracle_sql()}
