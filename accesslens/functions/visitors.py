"""Who asked for a scan, without keeping the address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def client_ip(forwarded_for: Column, peer: Column) -> Column:
    """First hop of the forwarding header, else the peer address, else empty."""
    first = F.trim(F.substring_index(F.coalesce(forwarded_for, F.lit("")), ",", 1), F.lit(" \t\r\n\x0b\x0c"))
    return F.coalesce(F.when(first != "", first), peer, F.lit(""))


def visitor_hash(ip: Column, salt: str) -> Column:
    """First 32 hex digits of the salted SHA-256 of an address.

    There are few IPv4 addresses, so whoever knows the salt can find them all: keep it secret.
    """
    known = F.when(F.coalesce(ip, F.lit("")) == "", "unknown").otherwise(ip)
    return F.substring(F.sha2(F.concat(F.lit(salt + "|"), known), 256), 1, 32)
