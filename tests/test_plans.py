from pathlib import Path

import pytest

from shirabe import queries
from shirabe.tables import Workspace

DATA = Path("/root/testdata/sf0.001")


def broadcast_parts(df):
    """The plan's text below each broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = lines[i + 1 :]
            end = next((n for n, x in enumerate(below) if depth(x) <= depth(line)), len(below))
            yield "\n".join(below[:end])


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["pages_by_file", "response_occurrences", "aggregate_totals", "terms_with_review", "next_unreviewed", "client_view_of_file", "client_view", "client_orders", "aggregate_across_docs", "candidate_csv_lines"])
def test_extracted_terms_are_not_broadcast(spark, monkeypatch, name):
    """Their size is guessed far too small, so that they filled the driver's memory."""
    seen, write = [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, *a: (seen.append(df), write(self, df, *a))[1])
    seen.append(queries.QUERIES[name](spark, str(DATA)))
    assert not [part for df in seen for part in broadcast_parts(df) if "_document_terms" in part]


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_the_orders_of_the_client_need_no_join_by_term(spark, monkeypatch):
    """Written terms are smaller in their files than in memory, so that such a join collected them in the driver."""
    seen, write = [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, *a: (seen.append(df), write(self, df, *a))[1])
    seen.append(queries.QUERIES["client_orders"](spark, str(DATA)))
    assert not [part for df in seen for part in broadcast_parts(df) if "term#" in part]


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["next_unreviewed", "terms_with_review", "client_view_of_file"])
def test_the_catalog_is_not_broadcast(spark, name):
    """It grows with the data, and its files are smaller than its rows."""
    assert not [part for part in broadcast_parts(queries.QUERIES[name](spark, str(DATA))) if "normalized_text#" in part]


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["client_view_of_file", "terms_with_review"])
def test_nothing_is_broadcast_as_it_runs(spark, name):
    """Adaptive execution plans again by the sizes of shuffled rows, which are smaller than in memory as well."""
    df = queries.QUERIES[name](spark, str(DATA))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastExchange" not in plan
