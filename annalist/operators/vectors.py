"""A table of vectors: (id, embedding, payload columns). Every operation gives the table that is to be stored next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import uuid5_url

PAYLOAD = ("repo_id", "source_type", "source_id", "text", "timestamp", "file_paths", "symbols_modified", "related_ids", "is_reverted")
UUID = r"(?i)^(?:urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"


def point_id(raw: Column) -> Column:
    """Ids that are no uuid become one."""
    return F.when(raw.rlike(UUID), raw).otherwise(uuid5_url(raw))


def points(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Rows of the table: chunks joined with their ``embeddings`` (id, embedding), with the names that a tenant goes by."""
    low = F.lower(F.trim(F.coalesce("repo_id", F.lit(""))))
    base = F.element_at(F.split(low, "/"), -1)
    tags = F.array_distinct(F.filter(F.array(F.coalesce("repo_id", F.lit("")), low, base), lambda x: x != ""))
    joined = chunks.select("id", *PAYLOAD).join(embeddings.select("id", "embedding"), "id")
    return joined.select(
        point_id(F.col("id")).alias("id"), F.col("id").alias("chunk_id"), "embedding", *PAYLOAD, base.alias("repo_base"), tags.alias("repo_aliases"),
        F.coalesce(F.unix_timestamp("timestamp"), F.lit(0)).alias("timestamp_unix"),
    )


def collection(stored: DataFrame, dimension: int, fresh: bool = False) -> DataFrame:
    """The stored rows of that dimension; none when the table is to be made anew or has another dimension."""
    return stored.where(F.lit(not fresh) & (F.size("embedding") == dimension))


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming points replace those of their ids; a table of another dimension is replaced as a whole."""
    first = incoming.select(F.size("embedding").alias("n")).limit(1).collect()
    kept = collection(stored, first[0].n) if first else stored
    return kept.join(incoming.select("id"), "id", "left_anti").select(*stored.columns).unionByName(incoming.dropDuplicates(["id"]).select(*stored.columns))


def delete(stored: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Without the points of ``chunk_ids`` (id)."""
    return stored.join(chunk_ids.select(point_id(F.col("id")).alias("id")), "id", "left_anti").select(*stored.columns)


def tenant(stored: DataFrame, repo_id: str | None, known: list[str] = ()) -> DataFrame:
    """Rows of a tenant: a repository id that the commits have for it, or its base name among a row's names."""
    if not repo_id:
        return stored
    base = repo_id.strip().lower().rsplit("/", 1)[-1]
    names = [repo_id, *known]
    return stored.where(F.col("repo_id").isin(*names) | (F.col("repo_base") == base) | F.array_contains("repo_aliases", base))


def embed(texts: DataFrame, call, batch: int = 100, dimension: int = 384) -> DataFrame:
    """(id, embedding, embedded) of ``texts`` (id, text): ``call`` maps a list of up to ``batch`` texts to vectors.

    A batch that fails, and a text without a vector, gets the offline vector and is not embedded.
    """
    from annalist.operators.search import mock_vector

    def run(frames):
        import pandas as pd

        for frame in frames:
            found = []
            for at in range(0, len(frame), batch):
                part = frame["text"].iloc[at : at + batch].fillna("").tolist()
                try:
                    got = list(call(part))
                except Exception:  # whatever a provider raises: its texts stay to be embedded
                    got = [None] * len(part)
                got += [None] * (len(part) - len(got))
                found += [(v if v is not None else mock_vector(t, dimension), v is not None) for t, v in zip(part, got)]
            yield pd.DataFrame({"id": frame["id"], "embedding": [f[0] for f in found], "embedded": [f[1] for f in found]})

    return texts.select("id", "text").mapInPandas(run, "id string, embedding array<float>, embedded boolean")
