"""Record hashing, key masking, nested columns to dotted names and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_record(columns: Sequence[str]) -> Column:
    """First 16 hex digits of sha256 over the compact JSON of the columns in name order."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)


def mask_key(key: Column) -> Column:
    return F.concat(F.substring(key, 1, 8), F.lit("..."))


def hash_key(key: Column) -> Column:
    return F.sha2(key, 256)


def _leaves(schema: T.StructType, prefix: tuple[str, ...] = ()):
    for f in schema.fields:
        path = (*prefix, f.name)
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, path)
        else:
            yield path


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct fields as top-level columns named by their path."""
    return df.select(
        *[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in _leaves(df.schema)]
    )


def unflatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Columns with path names back to nested structs."""
    tree: dict = {}
    for c in df.columns:
        node, parts = tree, c.split(sep)
        for p in parts[:-1]:
            node = node.setdefault(p, {})
        node[parts[-1]] = c

    def build(name: str, node) -> Column:
        if isinstance(node, str):
            return F.col(f"`{node}`").alias(name)
        return F.struct(*[build(k, v) for k, v in node.items()]).alias(name)

    return df.select(*[build(k, v) for k, v in tree.items()])
