"""Operators that prepare large text collections for training; nothing outside this subpackage imports it."""
