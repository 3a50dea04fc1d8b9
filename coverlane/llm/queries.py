"""All queries of this subpackage and their SQL checks."""

from coverlane.llm import bytebpe, centroids, chat, divergence, neighbours, packing, passages, pieces, quality, simhash, toxicity, urls, warc  # noqa: F401  each module registers its queries
from coverlane.llm.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
