"""Answer metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions import code


def cited_entities(text: Column) -> Column:
    """Distinct cited entities: shas (without those that begin a longer one), pr#N and issue#N. The number of a pull or an issue
    is no sha, however long it is."""
    every = lambda p, g: F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(g)), F.lower))
    parts = F.struct(every(r"\b[0-9a-fA-F]{7,40}\b", 0).alias("shas"), every(r"(?i)PR\s*#?(\d+)", 1).alias("pulls"), every(r"(?i)Issue\s*#?(\d+)", 1).alias("issues"))

    def entities(v: Column) -> Column:
        shas = F.filter(v["shas"], lambda s: ~F.array_contains(v["pulls"], s) & ~F.array_contains(v["issues"], s))
        whole = F.filter(shas, lambda s: ~F.exists(v["shas"], lambda t: (t != s) & F.startswith(t, s)))
        named = lambda kind, numbers: F.transform(numbers, lambda n: F.concat(F.lit(kind), n))
        return F.array_sort(F.array_distinct(F.concat(whole, named("pr#", v["pulls"]), named("issue#", v["issues"]))))

    return F.transform(F.array(parts), entities)[0]  # the text is searched once


def citation_metrics(generated: Column, expected: Column) -> Column:
    """struct(precision, recall, f1). All are 1 where nothing is expected. An expected reference is found if it holds, or is
    held by, a cited entity, or stands in the text; a cited entity is right if it holds, or is held by, an expected one."""
    text = F.coalesce(generated, F.lit(""))
    want = F.transform(expected, lambda e: F.lower(F.btrim(e)))

    def score(v: Column) -> Column:
        got, low, want = v["got"], v["low"], v["want"]
        near = lambda a, b: F.contains(a, b) | F.contains(b, a)
        found = F.size(F.filter(want, lambda e: F.exists(got, lambda g: near(g, e)) | F.contains(low, e))).cast("double")
        right = F.size(F.filter(got, lambda g: F.exists(want, lambda e: near(g, e)))).cast("double")
        r = found / F.size(want)
        p = F.when(F.size(got) == 0, 0.0).when(right > 0, right / F.size(got)).when(r >= 1, 1.0).otherwise(0.0)
        f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
        return F.struct(p.alias("precision"), r.alias("recall"), f1.alias("f1"))

    one = F.struct(*(F.lit(1.0).alias(c) for c in ("precision", "recall", "f1")))
    facts = F.struct(cited_entities(text).alias("got"), F.lower(text).alias("low"), want.alias("want"))  # the text is searched once
    return F.when(F.coalesce(F.size(want), F.lit(0)) <= 0, one).otherwise(F.transform(F.array(facts), score)[0])


def calibrated_accuracy(entailment: Column, citation_f1: Column, has_citations: Column) -> Column:
    return F.when(has_citations, 0.7 * entailment + 0.3 * citation_f1).otherwise(entailment)


def keyword_overlap(answer: Column, expected: Column) -> Column:
    """min(1, hits / (0.4 x words)) over the expected answer's words of four letters or more."""
    return code.word_overlap(answer, expected)


def clamped_cosine(a: Column, b: Column) -> Column:
    from annalist.operators.search import cosine

    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine(a, b), F.lit(0.0))))
