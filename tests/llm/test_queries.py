"""The queries that SQL can say, against their twins."""

import pytest

from peakflow.llm import queries  # noqa: F401
from peakflow.llm.registry import QUERIES, TWINS
from twins import connect, rows_of_query, rows_of_sql, types_of


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_twin(spark, sf_dir, name):
    con, df = connect(sf_dir), QUERIES[name](spark, sf_dir)
    assert rows_of_query(df) == rows_of_sql(con, TWINS[name])
    mine, theirs = types_of(df, con, TWINS[name])
    assert mine == theirs


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
