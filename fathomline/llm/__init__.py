"""Operators for preparing training text at scale: one module for each operator.

Nothing outside this subpackage imports it.
"""
