"""Operators on text collections. Nothing outside this subpackage imports it."""
