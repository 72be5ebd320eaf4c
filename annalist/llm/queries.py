"""Queries of the operators of this package, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import bpe, clustering, decontaminate, html_extract, near_dedup, packing, pii, quality_model, quality_rules, ranked_search, secret_scan, suffix_dedup, url_filter
from annalist.llm.common import table


def vocabulary() -> str:
    import public_tokenizers

    return os.environ.get("ANNALIST_BPE_RANKS") or public_tokenizers.path("byte_bpe_50k.tiktoken")


def word_vocabulary() -> str:
    import public_tokenizers

    return os.environ.get("ANNALIST_WORD_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, documents, labels = (table(spark, sf_dir, t) for t in ("pages", "documents", "labels"))
    return url_filter.judge(pages, url_filter.article_outcomes(pages, documents, labels)).drop("upper")


def op2_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digests(table(spark, sf_dir, "documents"))


def op4_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op5_benchmark_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op7_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op8_bpe_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), word_vocabulary()))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_url_reputation, op2_quality_ftrl, op3_secret_trigrams, op4_html_tree, op5_benchmark_wand, op6_repeated_bytes, op7_quality_divergence, op8_bpe_bitmap, op9_pii_votes, op10_near_dedup, op11_centroids, op12_packing, op13_ranked_search)}


def _shrink(level: str, units: str, mean: str, out: str) -> str:
    """CTEs: the strength of a level's prior by the method of moments, and its posterior means."""
    return f""", {level}_rho AS (SELECT sum((k - n * {mean}) ** 2) - sum(n * {mean} * (1 - {mean})) AS spread, sum(n * {mean} * (1 - {mean}) * (n - 1)) AS scale FROM {units}),
 {level}_s AS (SELECT 1 / greatest(least(coalesce(spread / nullif(scale, 0), 0), 1 / 1.5::DOUBLE), 1 / 1001::DOUBLE) - 1 AS s FROM {level}_rho),
 {level} AS (SELECT u.*, s, (k + s * {mean}) / (n + s) AS {out} FROM {units} u, {level}_s)"""


_LABELS = r"regexp_extract(host, '([^.]*\.){0,%d}[^.]*$')"
_LONG = f"{_LABELS % 1} IN ({', '.join(repr(x) for x in url_filter.LONG_SUFFIXES)})"
_DIGEST = r"md5(trim(regexp_replace(%s, '[ \t\n\v\f\r]+', ' ', 'g')))"
_BODY = r"regexp_replace(regexp_extract(html, '(?s)</h1>(.*)</article>', 1), '<[^>]*>', ' ', 'g')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
    _BODY = f"replace({_BODY}, '{_entity}', '{_char}')"

_OP1 = f"""WITH rest AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
 parsed AS (SELECT page_id, html, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
 known AS (SELECT {_DIGEST % "text"} AS digest, CAST(avg(quality) >= 0.5 AS INT) AS outcome FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL GROUP BY 1),
 bodies AS (SELECT host, {_BODY} AS body FROM parsed),
 by_host AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(outcome) AS DOUBLE) AS k FROM bodies JOIN known ON digest = {_DIGEST % "body"} WHERE body <> '' GROUP BY host),
 hosts AS (SELECT host, coalesce(n, 0) AS n, coalesce(k, 0) AS k, CASE WHEN {_LONG} THEN {_LABELS % 2} ELSE {_LABELS % 1} END AS domain, CASE WHEN {_LONG} THEN {_LABELS % 1} ELSE {_LABELS % 0} END AS suffix
  FROM (SELECT DISTINCT host FROM parsed) LEFT JOIN by_host USING (host)),
 total AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m0 FROM hosts),
 suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m0) AS m0 FROM hosts, total GROUP BY suffix){_shrink("by_suffix", "suffixes", "m0", "m1")},
 domains AS (SELECT domain, suffix, sum(h.n) AS n, sum(h.k) AS k, any_value(m1) AS m1 FROM hosts h JOIN by_suffix USING (suffix) GROUP BY domain, suffix){_shrink("by_domain", "domains", "m1", "m2")},
 units AS (SELECT host, h.n, h.k, m2 FROM hosts h JOIN by_domain USING (domain)){_shrink("posterior", "units", "m2", "m")},
 upper_bounds AS (SELECT host, least(1, m + 2 * sqrt(m * (1 - m) / (n + s + 1))) AS upper FROM posterior),
 rules(verdict, rule) AS (VALUES {', '.join(repr(r) for r in url_filter.RULES)}),
 fits AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM parsed JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
  AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY page_id)
SELECT page_id, p.host, path, rule, coalesce(verdict, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM parsed p LEFT JOIN fits USING (page_id) LEFT JOIN upper_bounds u ON p.host = u.host"""


def _distance(p: str, q: str, n: int) -> str:
    """Jensen-Shannon distance of two lists of n shares."""
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    terms = " + ".join(f"{part(f'{p}[{i}]', f'{q}[{i}]')} + {part(f'{q}[{i}]', f'{p}[{i}]')}" for i in range(1, n + 1))
    return f"round(sqrt(greatest(({terms}) / 2, 0)), 6)"


def _counted(pattern: str) -> str:
    return f"length(regexp_replace(t, '[^{pattern}]', '', 'g'))"


_N_CHARS = len(quality_rules.CLASSES)
_BY_LANG = " ".join(f"WHEN '{lang}' THEN {words}" for lang, words in quality_rules.COMMON_WORDS.items() if lang != "en")
_OP7 = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
 w AS MATERIALIZED (SELECT rid, doc_id, lang, length(t) AS size, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, {_counted("#*$%&|<>")} AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, {_counted(r"\p{L}\p{M}")} - {_counted(r"\p{Lu}")} AS low, {_counted(r"\p{Lu}")} AS up, {_counted("0-9")} AS digit,
  {_counted(r""".,;:!?''"()\-""")} AS stop, {_counted(r"@/\=+_\^~`\[\]{}")} AS punct, CASE lang {_BY_LANG} ELSE {quality_rules.COMMON_WORDS["en"]} END AS common FROM d),
 g AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
 r AS (SELECT rid, count(DISTINCT i + j) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS m FROM g), (VALUES (0), (1), (2)) v(j) WHERE m > 1 GROUP BY rid),
 x AS (SELECT w.*, len(w) AS n_words, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, size - word_chars AS space,
  [{", ".join(f"len(list_filter(w, lambda v: v = common[{i}]))" for i in range(1, 11))}] AS hits FROM w LEFT JOIN r USING (rid)),
 h AS MATERIALIZED (SELECT *, [low / z, up / z, digit / z, space / z, stop / z, (n_symbols + punct) / z, greatest(size - low - up - digit - space - stop - n_symbols - punct, 0) / z] AS pc,
  [{", ".join(f"hits[{i}] / y" for i in range(1, 11))}, (n_words - list_sum(hits)) / y] AS pw FROM (SELECT *, CAST(greatest(size, 1) AS DOUBLE) AS z, CAST(greatest(n_words, 1) AS DOUBLE) AS y FROM x)),
 refs AS (SELECT lang, grouping(lang) = 1 AS whole, count(*) AS n, [{", ".join(f"avg(pc[{i}])" for i in range(1, _N_CHARS + 1))}] AS c, [{", ".join(f"avg(pw[{i}])" for i in range(1, 12))}] AS v FROM h WHERE n_words >= 50 GROUP BY ROLLUP (lang)),
 m AS (SELECT h.*, coalesce(own.c, every.c) AS qc, coalesce(own.v, every.v) AS qw FROM h LEFT JOIN (SELECT * FROM refs WHERE NOT whole AND n >= 30) own ON h.lang IS NOT DISTINCT FROM own.lang LEFT JOIN (SELECT * FROM refs WHERE whole) every ON true),
 j AS (SELECT *, {_distance("pc", "qc", _N_CHARS)} AS char_distance, {_distance("pw", "qw", 11)} AS word_distance, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance,
 NOT base_failed AND NOT coalesce((word_chars >= 200 AND char_distance > 0.25) OR (n_words >= 100 AND coalesce(lang IN {tuple(quality_rules.COMMON_WORDS)}, false) AND word_distance > 0.25), false) AS kept FROM j"""



def _centroids_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds as one CTE each for assignments and centroids."""
    out = """WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS j, x AS c FROM kept ORDER BY sha256('2:' || vec_id), x LIMIT %d)""" % k
    for r in range(rounds + 1):
        out += f""",
 a{r} AS MATERIALIZED (SELECT rid, min({{'d': d, 'j': j}}) AS b FROM (SELECT rid, j, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{r}) GROUP BY rid)"""
        if r < rounds:
            out += f""",
 m{r} AS (SELECT j, i, CAST(floor(sum(v)::DECIMAL(38, 0) / count(*)) AS BIGINT) AS v FROM (SELECT b.j AS j, unnest(x) AS v, unnest(range(64)) AS i FROM a{r} JOIN kept USING (rid)) GROUP BY j, i),
 c{r + 1} AS MATERIALIZED (SELECT j, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT j, list(v ORDER BY i) AS c FROM m{r} GROUP BY j) n USING (j))"""
    return out + f"""
SELECT vec_id, CAST(b.j AS INT) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.j) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN kept USING (rid) JOIN c{rounds} ON j = b.j"""


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP13 = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
 s AS MATERIALIZED (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM d WHERE len(t) > 0),
 p AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY rid, term),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
 q AS (SELECT qid, item_id, term, count(*) AS qtf FROM (SELECT row_number() OVER () AS qid, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
 m AS (SELECT rid, doc_id, 75 + CAST((25 * len(t)::HUGEINT * n_docs) // n_terms AS BIGINT) AS m FROM d, s),
 scored AS (SELECT qid, item_id, rid, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL),
 ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20"""

ORACLE_SQL: dict[str, str] = {"op1_url_reputation": _OP1, "op7_quality_divergence": _OP7, "op11_centroids": _centroids_sql(), "op13_ranked_search": _OP13}
