"""Parts of the SQL that checks queries."""

from __future__ import annotations


def crc32_sql(column: str) -> str:
    """DuckDB expression of the CRC-32 of an integer in decimal: each byte is mixed in, then shifted out bit by bit."""
    steps = ", ".join(["-1"] * 8)
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
        string_split({column}::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, {steps}]))),
        lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""
