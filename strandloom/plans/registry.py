"""Query and oracle registries of the genome-analytics side of the library."""

from __future__ import annotations

from strandloom.plans import file_queries, functions_queries, graph_queries, kmer_queries, matrix_queries, sequence_queries, tree_queries

FLAGSHIP = "partition_summary"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (matrix_queries, graph_queries, functions_queries, sequence_queries, file_queries, tree_queries, kmer_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
