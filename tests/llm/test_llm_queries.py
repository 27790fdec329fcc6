"""The pN_ queries on the small tables, against their SQL where there is one."""

import pytest
from conftest import SMALL
from harness import connect, differences

from tracemill.llm import queries as llm

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert differences(spark, connect(SMALL), QUERIES[name], SQL[name], SMALL) is None
    else:
        rows = QUERIES[name](spark, SMALL)
        assert rows.count() == rows.distinct().count() > 0


def test_found_columns(spark):
    want = {
        "p1_found": ["sample_id"], "p2_found": ["judgment_id", "field_name", "raw_value", "criterion_id"], "p3_found": ["table_name", "record_id", "field_name", "defect"],
        "p4_found": ["table_name", "record_id", "field_name"], "p5_found": ["field_name", "id_a", "id_b"], "p6_found": ["field_name", "record_id", "turn_pos"],
        "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, SMALL).columns == columns
