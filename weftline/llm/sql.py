"""Parts that the SQL of several queries shares, for DuckDB."""

from __future__ import annotations

#: Two tables, put behind WITH: the CRC-32 of each byte, and t with all of them in v.
CRC_TABLE = """bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
t AS (SELECT list(v ORDER BY i) AS v FROM bits)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of an SQL expression, where t is joined."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda d: CAST('0x' || d AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda r, d: xor(r >> 8, t.v[xor(r & 255, d) + 1])), 4294967295)"


def words(text: str = "coalesce(text, '')") -> str:
    """A table, put behind WITH: doc_id, word and place p (from 1) of the words of documents."""
    return rf"words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents))"
