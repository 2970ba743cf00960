"""Full-text search over tables and change streams, as Spark DataFrame jobs."""

from .plans.index import Index, IndexView, view_of
from .plans.search import search, search_text

__all__ = ["Index", "IndexView", "search", "search_text", "view_of"]
