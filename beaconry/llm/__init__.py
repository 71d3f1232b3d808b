"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

Nothing outside this package imports it. Each module holds one operator with its own
interface; ``queries`` turns them into the registered queries.
"""
