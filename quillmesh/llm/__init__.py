"""Operators for preparing text, media and vectors at corpus scale.

Nothing outside this subpackage imports it.
"""
