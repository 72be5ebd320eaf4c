"""Lexical, vector and reference channels, and their weighted reciprocal-rank fusion."""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from annalist.functions import text as T
from annalist.functions.text import code_tokens, path_match, tenant_match, time_range
from annalist.operators import links, ranks
from annalist.storage import shared_folder

K1, B, EPSILON = 1.5, 0.75, 0.25

# fixed values: the fusion contract
RRF_K = 60
WEIGHTS = {"exact": 2.5, "symbol": 0.2, "dense": 1.0, "sparse": 1.0, "fallback": 0.2}
TOP_DENSE_WEIGHT = 3.2  # of the first dense hit with a score from 0.98 to under 1
COMMIT_TYPES = ("commit", "commit_diff", "historical_commit")
CODE_TYPES = ("code", "source_code", "ast_symbol", "file")
HISTORICAL = r"(?i)\b(why|revert|reverted|pr|issue|blame|sha|commit|author|history|deprecated|legacy|origin|motivation|reason|#\d+)\b"
STOPWORDS = frozenset(
    "why how what when where which with that this from into were been have some more make made "
    "here there then them they will would could should does done about after before added removed fixed "
    "changed change updating updated modify modified the and for also over under again only such handler".split()
)
# fixed values: words that name no symbol and that no fallback looks for
SYMBOL_STOPWORDS = frozenset(
    "http httpx python code file path test class func defs does how what where when why with from into request "
    "response session context global system method function module script option parameter config configuration "
    "default structure pattern design decision rationale implementation architecture hierarchy unify platform error "
    "handler interface server client common shared core base main init start stop close read write open save load "
    "update delete".split()
)


def filter_chunks(chunks: DataFrame, repo_id=None, source_types=None, is_reverted=None, file_path=None, date_from=None, date_to=None) -> DataFrame:
    """Conjunction of the search filters; applied before scoring, while statistics stay those of the whole corpus."""
    out = chunks.where(tenant_match(F.col("repo_id"), repo_id))
    if source_types:
        out = out.where(F.col("source_type").isin(*source_types))
    if is_reverted is not None:
        out = out.where(F.coalesce("is_reverted", F.lit(False)) == is_reverted)
    if file_path:
        out = out.where(path_match(F.col("file_paths"), file_path))
    return out.where(time_range(F.col("timestamp"), date_from, date_to)) if date_from or date_to else out


def postings_of(chunks: DataFrame, id_col: str = "id", text_col: str = "text", tokens=code_tokens) -> DataFrame:
    """(id, len, term, tf): a row for each distinct term of each text, counted in the text's own row before it is exploded.

    Tokens and the places where terms begin are bound by lambdas, and no condition stands on them before the rows are exploded:
    Spark would copy their expressions into it, and into each use of them, and cut the text again for each.
    """
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))

    def runs(t: Column) -> Column:
        begins = F.filter(F.transform(t, lambda w, i: F.when((i == 0) | (w != F.get(t, i - 1)), i)), lambda i: i.isNotNull())
        return bound(begins, lambda b: F.transform(b, lambda at, i: F.struct(F.size(t).alias("len"), F.get(t, at).alias("term"), (F.coalesce(F.get(b, i + 1), F.size(t)) - at).alias("tf"))))

    found = chunks.select(F.col(id_col).alias("id"), F.explode_outer(bound(F.sort_array(tokens(F.col(text_col))), runs)).alias("r"))
    return found.where("r is not null").select("id", "r.len", "r.term", "r.tf")


def raw_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5))


def bm25_fit(chunks: DataFrame, id_col: str = "id", text_col: str = "text", tokens=code_tokens, at: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, terms, corpus): (id, len, term, tf), (term, idf) and one row of (n, avg_len); stored under ``at`` if it is given.

    Texts are cut into tokens once: postings are written in the order of terms within each file, so that a search reads
    only the row groups of its words, and the statistics are read from them. A negative idf becomes EPSILON times the
    mean idf of all terms, negative ones included.
    """
    spark, at = chunks.sparkSession, at or f"{shared_folder(chunks.sparkSession)}/bm25-{uuid.uuid4().hex}"
    found = postings_of(chunks, id_col, text_col, tokens)
    found.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/postings")
    postings = spark.read.schema(found.schema).parquet(f"{at}/postings")
    size = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("n")))
    corpus = size.select("n", (F.col("words") / F.nullif("n", F.lit(0))).alias("avg_len"))
    raw = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(corpus.select("n"))).select("term", raw_idf(F.col("n"), F.col("df")).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    terms.write.mode("overwrite").parquet(f"{at}/terms")
    corpus.write.mode("overwrite").parquet(f"{at}/corpus")
    return bm25_load(spark, at)


def bm25_load(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``bm25_fit`` stored under ``at``."""
    return tuple(spark.read.parquet(f"{at}/{name}") for name in ("postings", "terms", "corpus"))


PUSHED_WORDS = 1000  # distinct words of all queries up to which they are a filter of the scan


def bm25_search(fitted, queries: DataFrame, allowed: DataFrame | None = None, tokens=code_tokens) -> DataFrame:
    """(query_id, id, score) for ``queries`` (query_id, query): repeated query words count; a score of zero or less is rescued
    as half the number of distinct query words in the text."""
    postings, terms, corpus = fitted
    words = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    named = [r.term for r in words.select("term").distinct().limit(PUSHED_WORDS + 1).collect()]
    if len(named) <= PUSHED_WORDS:
        postings, terms = (t.where(F.col("term").isin(*named)) for t in (postings, terms))
    rows = postings if allowed is None else postings.join(allowed.select("id"), "id", "left_semi")
    hit = rows.join(words.join(terms, "term"), "term").crossJoin(F.broadcast(corpus))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    total = hit.groupBy("query_id", "id").agg(F.sum(part).alias("s"), F.count(F.lit(1)).alias("overlap"))
    return total.select("query_id", "id", F.when(F.col("s") <= 0, 0.5 * F.col("overlap")).otherwise(F.col("s")).alias("score"))


def bm25_tenant(repo: Column, wanted: str | None) -> Column:
    """Equal ignoring case, or equal after the last slash; a row without a repository never matches."""
    if not wanted:
        return F.lit(True)
    low, want = F.lower(F.trim(repo)), wanted.strip().lower()
    return F.coalesce((low == want) | (F.substring_index(low, "/", -1) == want.rsplit("/", 1)[-1]), F.lit(False))


def lexical_tenant(chunks: DataFrame, repo_id: str | None) -> DataFrame:
    """The chunks of a tenant as the lexical channel knows it (``bm25_tenant``)."""
    return chunks.where(bm25_tenant(F.col("repo_id"), repo_id))


def top_k(hits: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def vector_search(vectors: DataFrame, query: list[float], k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """Exact filtered cosine top-k of ``vectors`` (id, embedding); nothing when the dimension differs."""
    rows = vectors if allowed is None else vectors.join(allowed.select("id"), "id", "left_semi")
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = rows.where(F.size("embedding") == len(query)).select("id", cosine(F.col("embedding"), q).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def mock_vector(text: str | None, dimension: int = 384) -> list[float]:
    """A reproducible unit vector seeded by the text's md5."""
    import hashlib
    import random

    rng = random.Random(int(hashlib.md5((text or "").encode()).hexdigest(), 16) % (1 << 32))
    v = [rng.uniform(-0.5, 0.5) for _ in range(dimension)]
    norm = sum(x * x for x in v) ** 0.5 or 1.0
    return [x / norm for x in v]


def mock_embedding(dimension: int = 384):
    """A pandas UDF of reproducible unit vectors; for tests and offline runs."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mock_vector(t, dimension))

    return embed


def exact_channel(chunks: DataFrame, shas: list[str], numbers: list[int], limit: int | None = 30) -> DataFrame:
    """(id, score 3.0): chunks whose source or text holds a sha, or that relate to or speak of #N; all of them, in no order, without a limit.

    A chunk speaks of N if its text has "#N" as a whole word, or says "PR N" or "issue N" and "#N" begins a word of it or of
    what it relates to.
    """
    low, cond = F.lower("text"), F.lit(False)
    if "related_ids" not in chunks.columns:
        chunks = chunks.withColumn("related_ids", F.array().cast("array<string>"))
    for s in shas:
        cond = cond | F.coalesce(F.contains(low, F.lit(s.lower())), F.lit(False)) | F.coalesce(F.contains(F.lower("source_id"), F.lit(s.lower())), F.lit(False))
    for n in numbers:
        mark = F.lit(f"#{n}")
        named = F.exists("related_ids", lambda r: F.contains(r, mark)) | F.contains("text", mark)
        relates = F.exists("related_ids", lambda r: F.lower(r).isin(f"pr#{n}", f"issue#{n}", f"#{n}", str(n)))
        says = F.col("text").rlike(rf"(?iU)(?:pr|issue|#)\s*#?{n}\b")
        cond = cond | (F.coalesce(named, F.lit(False)) & (F.coalesce(relates, F.lit(False)) | F.coalesce(says, F.lit(False))))
    found = chunks.where(cond).select("id", F.lit(3.0).alias("score"))
    return found if limit is None else found.orderBy("id").limit(limit)


def query_words(query: str, least: int = 4, stopwords: frozenset = SYMBOL_STOPWORDS) -> list[str]:
    """Identifiers of ``least`` characters or more that are not stopwords, in order."""
    import re

    words = re.findall(rf"\b([a-zA-Z_][a-zA-Z0-9_]{{{least - 1},}})\b", query)
    return [w for w in dict.fromkeys(words) if w.lower() not in stopwords]


def symbol_channel(chunks: DataFrame, query: str, symbols: DataFrame, limit: int = 30) -> DataFrame:
    """(id, score 2.0): chunks that touch a symbol whose name holds a word of the query that the name of some symbol holds."""
    words = F.array(*(F.lit(w.lower()) for w in query_words(query))).cast("array<string>")
    held = F.explode(F.filter(words, lambda w: F.contains(F.lower("symbol_name"), w)))
    known = F.array(*(F.lit(r.w) for r in symbols.select(held.alias("w")).distinct().collect())).cast("array<string>")  # words of the query
    hit = F.exists("symbols_modified", lambda s: F.exists(known, lambda w: F.contains(F.lower(s), w)))
    return chunks.where(hit).select("id", F.lit(2.0).alias("score")).orderBy("id").limit(limit)


def keyword_fallback(chunks: DataFrame, query: str, words: int = 4, per_word: int = 10) -> DataFrame:
    """(id, score 1.0): for when the other channels find fewer than five chunks."""
    out, known = None, [w.lower() for w in query.split() if len(w) >= 4 and w.lower() not in SYMBOL_STOPWORDS]
    for w in known[:words]:
        part = chunks.where(F.contains(F.lower("text"), F.lit(w.lower()))).select("id").orderBy("id").limit(per_word)
        out = part if out is None else out.union(part)
    out = out if out is not None else chunks.select("id").limit(0)
    return out.distinct().select("id", F.lit(1.0).alias("score"))


def rrf(hits: DataFrame, chunks: DataFrame, query: str, as_of_year: int, k: int = RRF_K, limit: int | None = 10, most: int | None = None) -> DataFrame:
    """(id, score) of fused ``hits`` (channel, id, score): the sum over channels of weight / (k + rank), by age and name boosts.

    Commits lose with their age in years (slower when the query asks for history), code gains, and a chunk whose symbol
    the query names, or whose text holds an identifier of the query, is boosted. ``most`` hits of each channel count, if
    it is given; without it all of a channel's hits are ranked, over ranges of their scores.
    """
    import re

    if most:  # as many partial sorts as there are channels, of which no task gets more than ``most`` rows each
        first = [hits.where(F.col("channel") == c).orderBy(F.desc("score"), "id").limit(most) for c in WEIGHTS]
        ranked = reduce(DataFrame.unionByName, first).withColumn("rank", F.row_number().over(W.partitionBy("channel").orderBy(F.desc("score"), "id")))
    else:
        ranked = ranks.group_rank(hits, "channel", [F.desc("score"), F.asc("id")])
    weight = F.lit(0.0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("channel") == name, w).otherwise(weight)
    weight = F.when((F.col("channel") == "dense") & (F.col("rank") == 1) & (F.col("score") >= 0.98) & (F.col("score") < 1.0), TOP_DENSE_WEIGHT).otherwise(weight)
    rate = 0.01 if re.search(HISTORICAL, query) else 0.03
    years = F.greatest(F.lit(as_of_year) - F.year("timestamp"), F.lit(0))
    decay = F.when(F.col("source_type").isin(*COMMIT_TYPES), F.coalesce(F.greatest(F.lit(0.35), F.exp(-rate * years)), F.lit(1.0))).when(F.col("source_type").isin(*CODE_TYPES), 1.25).otherwise(1.0)
    words = query_words(query, 3, STOPWORDS)
    low = F.array(*map(F.lit, sorted({w.lower() for w in words}))).cast("array<string>")
    bare = lambda s: F.concat(F.array(s), F.split(s, "::"), F.split(s, r"\."))
    named = F.exists("symbols_modified", lambda s: F.arrays_overlap(bare(F.lower(F.btrim(s))), low))
    identifiers = sorted({w.lower() for w in words if "_" in w or w != w.lower()})
    quoted = F.col("text").rlike(rf"(?i)\b(?:{'|'.join(identifiers)})\b") if identifiers else F.lit(False)
    boost = F.when(F.coalesce(named, F.lit(False)), 1.75).when(quoted, 1.15).otherwise(1.0)
    facts = chunks.select("id", (decay * boost).alias("_f"))
    fused = ranked.join(facts, "id").groupBy("id").agg(F.sum(weight / (k + F.col("rank")) * F.col("_f")).alias("score"))
    fused = fused.orderBy(F.desc("score"), "id")
    return fused.limit(limit) if limit else fused


def sanitized(query: str) -> str:
    """What ``functions.text.sanitize_query`` makes of a column, of one query."""
    import re

    out = re.sub(T.FLAG, "", re.sub(T.QUALIFIER, "", query))
    out = re.sub(T.LONE_DASHES, " ", out.replace('"', " ").replace("'", " "))
    return re.sub(r"\s+", " ", out).strip() or query


CHANNEL_HITS = 30  # of each query in each channel


def search_history(chunks: DataFrame, vectors: DataFrame | None, query: str, as_of_year: int, query_vector: list[float] | None = None, limit: int = 10, fitted=None, **filters) -> DataFrame:
    """Hybrid search: 30 lexical and 30 vector hits, fused. ``fitted`` is a stored index of the chunks; without it one is made."""
    spark = chunks.sparkSession
    allowed = filter_chunks(chunks, **filters)
    asked = spark.createDataFrame([(0, query)], "query_id int, query string")
    hits = top_k(bm25_search(fitted or bm25_fit(chunks), asked, allowed), CHANNEL_HITS).select(F.lit("sparse").alias("channel"), "id", "score")
    if vectors is not None and query_vector:
        hits = hits.unionByName(vector_search(vectors, query_vector, CHANNEL_HITS, allowed).select(F.lit("dense").alias("channel"), "id", "score"))
    found = rrf(hits, chunks, query, as_of_year, limit=limit, most=CHANNEL_HITS)
    text = F.when(F.length("text") > 4000, F.concat(F.left("text", F.lit(4000)), F.lit("\n[truncated]"))).otherwise(F.col("text"))
    return found.join(chunks, "id").select("id", "score", "source_type", "source_id", text.alias("text"), F.lit(True).alias("is_untrusted_data"))


def interleave(hits: DataFrame, first: int = 3) -> DataFrame:
    """``hits`` (sub_question_idx, id, score) with ``pos``: the top ones of each question in turn, then the rest by score."""
    ranked = ranks.group_rank(hits, "sub_question_idx", [F.desc("score"), F.asc("id")], "rn")
    early = F.col("rn") <= first
    keyed = ranked.withColumns({"_late": F.when(early, 0).otherwise(1), "_turn": F.when(early, F.col("rn")).otherwise(0), "_question": F.when(early, F.col("sub_question_idx")).otherwise(0)})
    return ranks.global_rank(keyed, [F.asc("_late"), F.asc("_turn"), F.asc("_question"), F.desc("score"), F.asc("id")], "pos").drop("_late", "_turn", "_question")


def within_budget(evidence: DataFrame, budget: int, least_tail: int = 200) -> DataFrame:
    """The first rows of ``evidence`` (pos, line) that fit the budget of characters, never none; the row that overflows is
    cut to what is left if that is over ``least_tail``."""
    sized = evidence.select("pos", F.length("line").alias("n"))
    run = ranks.running_sum(sized, [F.asc("pos")], "n", "end")
    over = run.where((F.col("end") > budget) & (F.col("n") > 0)).agg(F.min(F.struct("pos", (F.col("end") - F.col("n")).alias("begin"))).alias("o"))  # one row
    rows = evidence.crossJoin(F.broadcast(over.select(F.col("o.pos").alias("_over"), F.col("o.begin").alias("_begin"))))
    cut = (F.col("pos") == F.col("_over")) & ((budget - F.col("_begin") > least_tail) | (F.col("_begin") == 0))
    line = F.when(cut, F.substr("line", F.lit(1), (budget - F.col("_begin")).cast("int"))).otherwise(F.col("line"))
    return rows.where(F.col("_over").isNull() | (F.col("pos") < F.col("_over")) | cut).select("pos", line.alias("line"))


def channel_hits(
    chunks: DataFrame, fitted, queries: list[str], symbols: DataFrame, pulls: DataFrame, issues: DataFrame, commits: DataFrame,
    vectors: DataFrame | None = None, query_vectors: list[list[float]] = (), **filters,
) -> DataFrame:
    """(channel, id, score) of several queries: what each channel finds, a chunk once in each, as the first query that finds it scores it.

    Queries are sanitised, but shas and numbers are looked for in them as they are, and count only where they are recorded;
    texts are looked through when the exact and symbol channels find fewer than five.
    """
    import re

    spark, said, clean = chunks.sparkSession, "\n".join(queries), [sanitized(q) for q in queries]
    allowed = filter_chunks(chunks, **filters)
    asked = spark.createDataFrame(list(enumerate(clean)), "query_id int, query string")
    first = lambda df, channel: df.groupBy("id").agg(F.min_by("score", "query_id").alias("score")).select(F.lit(channel).alias("channel"), "id", "score")
    every = lambda found: reduce(DataFrame.unionByName, [f.select(F.lit(i).alias("query_id"), "id", "score") for i, f in enumerate(found)])
    lexical = lexical_tenant(filter_chunks(chunks, **{k: v for k, v in filters.items() if k != "repo_id"}), filters.get("repo_id"))
    hits = first(top_k(bm25_search(fitted, asked, lexical), CHANNEL_HITS), "sparse")
    if vectors is not None and query_vectors:
        hits = hits.unionByName(first(every([vector_search(vectors, v, CHANNEL_HITS, allowed) for v in query_vectors]), "dense"))
    refs = lambda found: spark.createDataFrame([(x,) for x in sorted(set(found))], "ref string")
    shas = refs(x for x in re.findall(r"\b([0-9a-fA-F]{7,40})\b", said) if not x.isdigit())
    shas = [r.ref for r in links.known_shas(shas, commits, filters.get("repo_id")).collect()]
    numbers = [int(r.ref) for r in links.known_numbers(refs(re.findall(r"#(\d+)", said)), pulls, issues, filters.get("repo_id")).collect()]
    exact = first(every([exact_channel(allowed, shas, numbers)]), "exact")
    symbol = first(every([symbol_channel(allowed, q, symbols) for q in clean]), "symbol").join(exact, "id", "left_anti")
    hits = hits.unionByName(exact).unionByName(symbol)
    if exact.unionByName(symbol).select("id").distinct().limit(5).count() < 5:
        back = first(every([keyword_fallback(allowed, q) for q in clean]), "fallback")
        hits = hits.unionByName(back.join(exact.unionByName(symbol), "id", "left_anti"))
    return hits


def search_many(chunks: DataFrame, fitted, queries: list[str], as_of_year: int, symbols: DataFrame, pulls: DataFrame, issues: DataFrame, commits: DataFrame, limit: int = 10, **more) -> DataFrame:
    """(id, score) of several queries at once: the hits of ``channel_hits``, fused with the first query."""
    hits = channel_hits(chunks, fitted, queries, symbols, pulls, issues, commits, **more)
    return rrf(hits, chunks, sanitized(queries[0]), as_of_year, limit=limit, most=4 * CHANNEL_HITS * len(queries))
