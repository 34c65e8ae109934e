"""Imports every module that registers queries."""

from . import checks, scalars, scans, streams, tables  # noqa: F401
