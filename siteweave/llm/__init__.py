"""Operators for the preparation of training text at scale.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface; ``registry`` binds them to the synthetic tables as the ``opN_<name>`` queries.
"""
