"""Keyed tables of collections, sessions, links and connections: reading, upserts, deletes, toggles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.operators.ordering import numbered
from corpusloom.operators.sizing import cut_lineage, small


def active(collections: DataFrame, selected: DataFrame | None = None, key: str = "collection_id") -> DataFrame:
    """Active collections, only the selected ones when a selection is given."""
    kept = collections.filter(F.col("status") == "active")
    return kept if selected is None else kept.join(selected.select(key), key, "left_semi")


def owned(rows: DataFrame, user: Column, enforce: bool = True) -> DataFrame:
    return rows.filter(F.col("user_id") == user) if enforce else rows


def sessions_with_counts(sessions: DataFrame, messages: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest sessions with their number of messages.  Only messages of those sessions are counted."""
    newest = sessions.orderBy(F.desc("updated_at"), F.asc("session_id")).limit(limit)
    newest = cut_lineage(newest)
    counts = messages.join(F.broadcast(newest.select("session_id")), "session_id", "left_semi").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return newest.join(counts, "session_id", "left").select(
        *sessions.columns, F.coalesce("n", F.lit(0)).alias("message_count")
    )


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, tie: str | None = None) -> DataFrame:
    """Parents with their children as ordered rows, one row per child, so no parent becomes one big cell."""
    return parents.join(numbered(children, [key], order, "position", tie=tie), key, "left")


def orphans(stored: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """Stored keys that the registry does not know."""
    return stored.join(registered.select(key), key, "left_anti")


def registered_with_orphans(stored: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    found = orphans(stored, registered, key).withColumn("status", F.lit("active"))
    return registered.unionByName(found, allowMissingColumns=True)


def upserted(existing: DataFrame, incoming: DataFrame, key: str, replace: list[str], version: str = "updated_at") -> DataFrame:
    """Insert or replace by key: the newest row wins, a stored row keeps its created_at.

    Both sides are reduced per key before the shuffle.  On equal versions incoming rows win.
    """
    both = existing.withColumn("__in", F.lit(0)).unionByName(incoming.withColumn("__in", F.lit(1)), allowMissingColumns=True)
    newest = F.max_by(F.struct(*replace), F.struct(version, "__in"))
    return both.groupBy(key).agg(
        newest.alias("row"),
        F.coalesce(F.min(F.when(F.col("__in") == 0, F.col("created_at"))), F.min("created_at")).alias("created_at"),
        F.max(version).alias(version),
    ).select(key, *[F.col(f"row.{c}").alias(c) for c in replace], "created_at", version)


def deleted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows without the deleted keys; the same call on a child table is the cascade."""
    return rows.join(small(keys.select(key)), key, "left_anti")


def children_replaced(children: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All children of the keys in ``fresh`` are replaced by the fresh ones."""
    return deleted(children, fresh.select(key).distinct(), key).unionByName(fresh)


def toggled(rows: DataFrame, hit: Column, on: bool, now: Column) -> DataFrame:
    status = "active" if on else "inactive"
    return rows.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn(
        "updated_at", F.when(hit, now).otherwise(F.col("updated_at"))
    )


def first_seen(rows: DataFrame, keys: list[Column], names: list[str], order: str) -> DataFrame:
    """One row per key: the first along ``order``."""
    others = [c for c in rows.columns if c not in names]
    return rows.groupBy(*[k.alias(n) for k, n in zip(keys, names)]).agg(
        F.min_by(F.struct(*others), order).alias("row")
    ).select(*names, "row.*")


def last_seen(rows: DataFrame, keys: list[Column], names: list[str], order: str) -> DataFrame:
    """One row per key: the last along ``order``."""
    others = [c for c in rows.columns if c not in names]
    return rows.groupBy(*[k.alias(n) for k, n in zip(keys, names)]).agg(
        F.max_by(F.struct(*others), order).alias("row")
    ).select(*names, "row.*")
