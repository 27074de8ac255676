import os

import pytest
from conftest import DATA

import oracle
from tallyframe.llm import queries

COLUMNS = {
    "p1_found": ["name_a", "name_b"], "p2_found": ["invoice_id", "code"], "p3_found": ["page_id"], "p4_found": ["address_a", "address_b"], "p6_found": ["route_id"],
    "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    df = queries.queries()[name](spark, DATA)
    assert df.columns == COLUMNS[name]
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert len(rows) == len(set(rows)) > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, db, name):
    assert oracle.compare(queries.queries()[name](spark, DATA), db, queries.oracle_sql()[name]) == ""
