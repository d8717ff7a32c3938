"""A retrieval and text-processing engine on Spark DataFrames."""

from importlib import import_module

__version__ = "0.1.0"
_FROM = {
    "Collection": "client", "Hit": "client", "Store": "store", "bm25": "operators.lexical", "bm25_batch": "operators.lexical", "chunk_documents": "operators.chunking",
    "knn": "operators.knn", "knn_batch": "operators.knn", "parse_file": "sources.files", "read_files": "sources.files",
}
__all__ = sorted(_FROM)


def __getattr__(name: str):
    # on first use, as the executors' Python workers import this package for a module or two
    if name in _FROM:
        return getattr(import_module(f"vsearch.{_FROM[name]}"), name)
    raise AttributeError(name)
