"""Queries: importing the modules registers them."""

from loomgraph.plans import graph_queries, model_queries, pipeline_queries, relational_queries, sampling_queries, source_queries, stream_queries  # noqa: F401
from loomgraph.plans.registry import QUERIES, SQL  # noqa: F401
