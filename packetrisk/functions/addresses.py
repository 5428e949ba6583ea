"""Tests of addresses and ports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetrisk.config import LOCAL_SOURCE_PREFIXES, PRIVATE_PREFIXES


def _starts(ip: Column, prefixes: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (ip.startswith(p) for p in prefixes)), F.lit(False))


def is_local_source(ip: Column) -> Column:
    """The scorer's local test."""
    return _starts(ip, LOCAL_SOURCE_PREFIXES)


def is_private(ip: Column) -> Column:
    """The test of the trend report and of the block ledger."""
    return _starts(ip, PRIVATE_PREFIXES)


def is_ipv4_shape(ip: Column) -> Column:
    """Four groups of one to three digits; octets are not range-checked; null is false."""
    return F.coalesce(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.lit(False))


def is_valid_port(port: Column) -> Column:
    return F.coalesce(port.between(1, 65535), F.lit(False))
