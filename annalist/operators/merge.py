"""Merges of incremental ingestion, as joins of the stored and the incoming table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], frozen: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: incoming values replace stored ones where they are not null; ``frozen`` columns keep what is stored."""
    s, n = stored.alias("s"), incoming.dropDuplicates(keys).alias("n")
    cond = [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    pick = lambda c: F.coalesce(f"s.{c}", f"n.{c}") if c in keys or c in frozen else F.coalesce(f"n.{c}", f"s.{c}")
    return s.join(n, cond, "full").select(*(pick(c).alias(c) for c in stored.columns))


def upsert_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunks by id: a changed text, flag or set overwrites and asks for a new embedding; an unchanged one keeps its flag."""
    same = F.lit(True)
    for c in ("text", "is_reverted"):
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}"))
    for c in ("file_paths", "symbols_modified", "related_ids"):
        same = same & F.array_sort(F.array_distinct(f"s.{c}")).eqNullSafe(F.array_sort(F.array_distinct(f"n.{c}")))
    joined = stored.alias("s").join(incoming.dropDuplicates(["id"]).alias("n"), F.col("s.id") == F.col("n.id"), "full")
    keep = F.col("n.id").isNull() | (F.col("s.id").isNotNull() & same)
    return joined.select(*(F.when(keep, F.col(f"s.{c}")).otherwise(F.lit(False) if c == "embedded" else F.col(f"n.{c}")).alias(c) for c in stored.columns))


def purge(stored: DataFrame, current: DataFrame, source_types: list[str]) -> DataFrame:
    """Without the chunks of these source types that the current run did not make."""
    gone = F.col("source_type").isin(*source_types)
    return stored.where(~gone).unionByName(stored.where(gone).join(current.select("id").distinct(), "id", "left_semi"))


def reset_embeddings(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("embedded", F.lit(False))


def embed_pending(chunks: DataFrame, embed, text_col: str = "text") -> DataFrame:
    """(id, embedding) of the chunks not embedded yet; ``embed`` is a column function or pandas UDF."""
    return chunks.where(~F.col("embedded")).select("id", embed(F.col(text_col)).alias("embedding")).where("embedding is not null")


def mark_embedded(chunks: DataFrame, done: DataFrame) -> DataFrame:
    flag = done.select("id").distinct().withColumn("_d", F.lit(True))
    return chunks.join(flag, "id", "left").withColumn("embedded", F.col("embedded") | F.coalesce("_d", F.lit(False))).drop("_d").select(*chunks.columns)


def upsert_meta(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Facts of repositories: what a run knows replaces what is stored, and what it does not know stays; so does created_at."""
    return upsert(stored, incoming, ["repo_id"], ("created_at",))


def write_partitions(df: DataFrame, path: str) -> None:
    """Overwrite only the repositories in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)
