"""A segmented inverted index: deltas of postings with tombstones, statistics that are merged when a query asks, and compaction.

A segment is what one change adds: postings of the new texts, net counts of texts by term (``df``, in which texts that the
change replaces or deletes count as negative), and the ids whose older copies it ends (``dead``). Segments are numbered; a
posting counts unless a later segment has ended its id. What a search needs of the whole (number of texts, words, and the
mean idf over all terms) is kept with the segments, so a query reads the rows of its own words alone, and a change
tokenises only what has changed.

An index is the plain value that ``facts`` gives, which a store commits together with its tables, and folders of Parquet
that are never changed.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators.search import EPSILON, postings_of, raw_idf
from annalist.storage import written

MOST_SEGMENTS = 8  # beyond which an index is to be compacted
DEAD_SHARE = 0.25  # of all texts, likewise

POSTINGS, TERMS, DEAD = "id string, len int, term string, tf int", "term string, df long", "id string"


class Index:
    """``folder`` holds the segments; ``facts`` is {"segments": [...], "next": n, "n": texts, "words": words, "mean": mean idf, "dead": texts ended}."""

    def __init__(self, spark: SparkSession, folder: str, facts: dict | None = None):
        self.spark, self.folder = spark, folder
        self.facts = facts or {"segments": [], "next": 0, "n": 0, "words": 0, "mean": 0.0, "dead": 0}

    # --- reading ----------------------------------------------------------------------------------------------------------

    def _rows(self, kind: str, schema: str, numbered: bool = False) -> DataFrame:
        parts = []
        for s in self.facts["segments"]:
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{s['at']}/{kind}")
            parts.append(rows.withColumn("segment", F.lit(s["number"])) if numbered else rows)
        empty = self.spark.createDataFrame([], schema + (", segment int" if numbered else ""))
        return reduce(DataFrame.unionByName, parts) if parts else empty

    def postings(self) -> DataFrame:
        """(id, len, term, tf) of the texts as they are now; conditions on the term reach the scans."""
        rows = self._rows("postings", POSTINGS, True)
        if not self.facts["dead"]:
            return rows.drop("segment")
        dead = self._rows("dead", DEAD, True).groupBy("id").agg(F.max("segment").alias("_ended"))
        alive = rows.join(dead, "id", "left").where(F.col("_ended").isNull() | (F.col("segment") >= F.col("_ended")))
        return alive.select("id", "len", "term", "tf")

    def counts(self) -> DataFrame:
        """(term, df): in how many texts each term is now."""
        return self._rows("terms", TERMS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def fitted(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(postings, terms, corpus), as ``search.bm25_search`` takes them."""
        raw = self.counts().select("term", raw_idf(F.lit(float(self.facts["n"])), F.col("df")).alias("raw"))
        idf = F.when(F.col("raw") < 0, F.lit(EPSILON * self.facts["mean"])).otherwise(F.col("raw"))
        average = self.facts["words"] / self.facts["n"] if self.facts["n"] else None
        corpus = self.spark.createDataFrame([(self.facts["n"], average)], "n long, avg_len double")
        return self.postings(), raw.select("term", idf.alias("idf")), corpus

    # --- changing ---------------------------------------------------------------------------------------------------------

    def _segment(self, number: int, postings: DataFrame, terms: DataFrame, dead: DataFrame) -> dict:
        at = f"segment-{number}-{uuid.uuid4().hex}"
        postings.select("id", "len", "term", "tf").sortWithinPartitions("term").write.parquet(f"{self.folder}/{at}/postings")
        terms.select("term", "df").sortWithinPartitions("term").write.parquet(f"{self.folder}/{at}/terms")
        dead.select("id").write.parquet(f"{self.folder}/{at}/dead")
        return {"at": at, "number": number}

    def _with_mean(self, facts: dict) -> Index:
        out = Index(self.spark, self.folder, facts)
        mean = out.counts().agg(F.avg(raw_idf(F.lit(float(facts["n"])), F.col("df")))).first()[0] if facts["n"] else None
        facts["mean"] = float(mean or 0.0)
        return out

    def changed(self, incoming: DataFrame, gone: DataFrame) -> Index:
        """The index with the texts of ``incoming`` (id, text) added or in place of those of their ids, and without those of ``gone`` (id).

        Ids of ``incoming`` are distinct. A null text is a text without words. An id that is not in the index is not missed.
        """
        number = self.facts["next"]
        new = written(postings_of(incoming), "postings")
        # texts without words have no postings: a marker term without a word keeps their ids, to be counted and ended
        bare = incoming.select("id").join(new.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).alias("len"), F.lit("").alias("term"), F.lit(1).alias("tf"))
        new = written(new.unionByName(bare), "postings")
        named = incoming.select("id").unionByName(gone.select("id")).distinct()
        old = self.postings().join(named, "id", "left_semi")
        old = written(old, "ended")
        dead = old.select("id").distinct()
        net = new.select("term", F.lit(1).alias("v")).unionByName(old.select("term", F.lit(-1).alias("v"))).where("term != ''")
        terms = net.groupBy("term").agg(F.sum("v").alias("df")).where("df != 0")
        totals = lambda df: df.agg(F.countDistinct("id").alias("n"), F.coalesce(F.sum(F.when(F.col("term") != "", F.col("tf"))), F.lit(0)).alias("words")).first()
        plus, minus = totals(new), totals(old)
        if not (plus.n or minus.n):
            return self
        segment = self._segment(number, new, terms, dead)
        facts = {**self.facts, "segments": [*self.facts["segments"], segment], "next": number + 1, "n": self.facts["n"] + plus.n - minus.n, "words": self.facts["words"] + plus.words - minus.words, "dead": self.facts["dead"] + minus.n}
        return self._with_mean(facts)

    def follow(self, before: DataFrame, after: DataFrame) -> Index:
        """The index of the texts of ``after`` (id, text), where it is one of those of ``before``: what differs is a change."""
        b, a = before.select("id", F.col("text").alias("_was")), after.select("id", "text")
        differ = a.join(b.withColumn("_known", F.lit(True)), "id", "left").where(F.col("_known").isNull() | ~F.col("text").eqNullSafe(F.col("_was"))).select("id", "text")
        gone = b.join(a.select("id"), "id", "left_anti").select("id")
        return self.changed(written(differ, "changed"), gone)

    def needs_compaction(self) -> bool:
        return len(self.facts["segments"]) > MOST_SEGMENTS or self.facts["dead"] > DEAD_SHARE * max(self.facts["n"], 1)

    def compacted(self) -> Index:
        """The same index as one segment without tombstones; no text is tokenised again."""
        number = self.facts["next"]
        segment = self._segment(number, self.postings(), self.counts(), self.spark.createDataFrame([], DEAD))
        return Index(self.spark, self.folder, {**self.facts, "segments": [segment], "next": number + 1, "dead": 0})
