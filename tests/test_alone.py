"""Queries that start Python workers work as the first one of an application."""

import pytest


@pytest.mark.parametrize("name", ["json_repair", "nj_tree", "fuzzy_name_match", "sheet_read", "retried_calls", "call_actions", "table_of_services"])
def test_query_alone(alone, name):
    alone(name)
