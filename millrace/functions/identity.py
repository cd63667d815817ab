"""Stable ids, near-duplicate keys and splits by content hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX_CHARS = 600
_NUL = "\u0000"


def doc_id(source: Column, key: Column) -> Column:
    return F.concat(F.lit("jp_"), F.substring(F.sha2(F.concat(source, F.lit(_NUL), key), 256), 1, 10))


def fallback_key(text: Column) -> Column:
    return F.sha2(text, 256)


def prefix_hash(text: Column, chars: int = PREFIX_CHARS) -> Column:
    return F.sha1(F.substring(text, 1, chars))


def bucket(id_: Column) -> Column:
    """0 to 99."""
    return F.conv(F.substring(F.sha2(id_, 256), 1, 8), 16, 10).cast("bigint") % 100


def split(id_: Column) -> Column:
    b = bucket(id_)
    return F.when(b < 5, "eval_pool").when(b < 10, "dev").otherwise("train")


def prompt_sha(*parts: Column) -> Column:
    """Sixteen digits over the parts joined by NUL; a null part counts as empty."""
    joined = parts[0] if len(parts) == 1 else F.concat(*[x for p in parts[:-1] for x in (F.coalesce(p, F.lit("")), F.lit(_NUL))], F.coalesce(parts[-1], F.lit("")))
    return F.substring(F.sha2(joined, 256), 1, 16)


def ids_digest(ids: Column) -> Column:
    """Digest of a group's ids, whatever their order (an aggregate)."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(ids)), ","), 256)
