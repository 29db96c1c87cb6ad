"""Operators for text and source collections; nothing outside this subpackage imports it."""
