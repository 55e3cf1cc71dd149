"""Registered queries and the SQL that checks them."""

from maskwright.plans import registry, review, streams, tables  # noqa: F401  all register
