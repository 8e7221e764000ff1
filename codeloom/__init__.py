"""Code-corpus indexing and exact vector search on Spark."""

from importlib import import_module

_API = {
    "build_index": "plans.build", "list_indexes": "plans.build", "search": "plans.search", "open_index": "plans.search", "SearchEngine": "plans.search",
    "HashingEmbedder": "operators.embed", "RemoteEmbedder": "operators.embed", "knn": "operators.index", "knn_batch": "operators.index",
}
__all__ = list(_API)


def __getattr__(name: str):
    if name in _API:
        return getattr(import_module(f"codeloom.{_API[name]}"), name)
    raise AttributeError(name)
