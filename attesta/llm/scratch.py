"""Intermediate tables in the shared folder, and settings the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta.session import materialise, scratch_path

__all__ = ["identity", "materialise", "scratch_path", "fresh"]


def fresh(df: DataFrame, *taken: str) -> list[str]:
    """Names like ``taken`` that no column of ``df`` has."""
    have, out = {c.lower() for c in df.columns}, []
    for name in taken:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def identity(key: str, text: str) -> list[Column]:
    """Two columns naming a row by its id and its text: rows that agree in both are equal for every text operator, and
    rows without an id are told apart by their text."""
    return [F.coalesce(F.col(key).cast("long"), F.xxhash64(text)).alias("row_id"),
            F.hash(F.col(key).isNull(), F.col(text)).alias("row_hash")]
