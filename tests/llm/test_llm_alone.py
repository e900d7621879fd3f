"""Operators that start Python workers work as the first one of an application."""

import pytest


@pytest.mark.parametrize("name", ["op4_warc", "op6_benchmark_tiling", "op8_url_rules", "op9_byte_bpe", "op11_centroid_clusters", "op12_vector_codes", "op13_embedding_duplicates"])
def test_query_alone(alone, name):
    alone(name)
