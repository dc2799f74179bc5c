"""Training-data operators: thirteen stand-alone jobs over documents, pages and embeddings.

Nothing outside this subpackage imports it.
"""
