"""Citation-network analytics and record processing on Spark.

The names most programs need are here; everything else is in the modules.
"""

from .operators.authors import apply_author_actions, authors_of, correlated_persons, match_authors
from .operators.compact import consolidate, repeated_documents
from .operators.crawl import CitationSource, CrawlResult, crawl
from .operators.graphstore import merge_cites, merge_publications, publication_batch
from .operators.predicates import crawl_predicate, keyword_match, stored_predicate
from .operators.shred import FlatTable, shred
from .operators.skew import heavy_keys, skew_join
from .session import build_session
from .sinks.graph_json import write_json_graph, write_tables
from .sinks.property_graph import GraphSink, PropertyGraph
from .sources.seeds import seed_authors, seed_papers, seed_papers_keywords

__all__ = [
    "CitationSource", "CrawlResult", "FlatTable", "GraphSink", "PropertyGraph", "apply_author_actions", "authors_of", "build_session", "consolidate",
    "correlated_persons", "crawl", "crawl_predicate", "heavy_keys", "keyword_match", "match_authors", "merge_cites", "merge_publications", "publication_batch",
    "repeated_documents", "seed_authors", "seed_papers", "seed_papers_keywords", "shred", "skew_join", "stored_predicate", "write_json_graph", "write_tables",
]
