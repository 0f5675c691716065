"""Operators of a training-data pipeline: text, tokens, near copies, pages and archives.

Nothing outside this folder imports it.  Each module is one operator with its own general
interface; ``queries`` binds them to the given tables.
"""
