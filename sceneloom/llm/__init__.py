"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``benchmark``.

Nothing outside this subpackage imports it. ``registry`` lists its queries.
"""
