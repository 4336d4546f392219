"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it. Every operator takes a DataFrame, names its columns by
parameters, and carries working columns under names that start with ``__q_`` so that extra input
columns cannot clash with them.
"""
