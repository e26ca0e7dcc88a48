"""Queries that must return a row for each row of the table they start from."""

import pytest

from ledgerlift.catalog import QUERIES
from ledgerlift.catalog.registry import Tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table", [("l7_needs_new_template", "merge_inputs"), ("f23_attach_text_metadata", "jobs")])
def test_no_row_is_dropped(spark, name, table):
    got = sorted(r.job_id for r in QUERIES[name](spark, SF_DIR).collect())
    assert got == sorted(r.job_id for r in getattr(Tables(spark, SF_DIR), table).select("job_id").collect())
