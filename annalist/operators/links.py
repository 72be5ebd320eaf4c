"""Cross links, revert resolution, line-to-symbol joins and edges. Prefix and range conditions always ride on an equi key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from annalist.functions.text import extract_refs, first_line, node_key, pulls_in_message, revert_target, reverted_subject, tenant_match
from annalist.storage import written


def new_rows(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not known yet."""
    return incoming.join(known.select(*keys).distinct(), keys, "left_anti")


def issue_links(pulls: DataFrame, issues: DataFrame, require_existing: bool = True) -> DataFrame:
    """(repo_id, pr_number, issue_number): the symmetric closure of references of pulls to issues and back, in titles, bodies
    and, where the tables have them, comments."""

    def refs(df, mine, other):
        said = [F.transform(c, lambda x: x["body"]) for c in ("review_comments", "comments") if c in df.columns]
        text = F.concat_ws(" ", "title", "body", *said)
        r = extract_refs(text)
        return df.select("repo_id", F.col("number").alias(mine), F.explode(F.array_union(r["closes"], r["mentions"])).alias(other))

    there, back = refs(pulls, "pr_number", "issue_number"), refs(issues, "issue_number", "pr_number")
    if require_existing:
        there = there.join(issues.select("repo_id", F.col("number").alias("issue_number")).distinct(), ["repo_id", "issue_number"], "left_semi")
    back = back.join(pulls.select("repo_id", F.col("number").alias("pr_number")).distinct(), ["repo_id", "pr_number"], "left_semi")
    return there.unionByName(back).select("repo_id", "pr_number", "issue_number").distinct()


def link_arrays(links: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return links.groupBy("repo_id", key).agg(F.array_sort(F.collect_set(value)).alias(name))


def pull_of_commit(pulls: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, sha, pr_number): a pull names a commit by its sha, a prefix of seven or more, or its merge sha; the latest pull wins."""
    named = pulls.select("repo_id", F.col("number").alias("pr_number"), F.explode(F.array_compact(F.array_union("linked_commit_shas", F.array("merge_commit_sha")))).alias("ref")).where(F.length("ref") >= 7)
    left = commits.select("repo_id", "sha", F.left("sha", F.lit(7)).alias("sha7"))
    hit = left.join(named.withColumn("sha7", F.left("ref", F.lit(7))), ["repo_id", "sha7"]).where(F.startswith("sha", "ref"))
    return hit.groupBy("repo_id", "sha").agg(F.max("pr_number").alias("pr_number"))


def pull_of_message(commits: DataFrame, pulls: DataFrame) -> DataFrame:
    """(repo_id, sha, pr_number): of the numbers that a message may name pulls with, the first that is one."""
    named = commits.select("repo_id", "sha", F.posexplode(pulls_in_message(F.col("message"))).alias("at", "pr_number"))
    there = named.join(pulls.select("repo_id", F.col("number").alias("pr_number")).distinct(), ["repo_id", "pr_number"], "left_semi")
    return there.groupBy("repo_id", "sha").agg(F.min_by("pr_number", "at").alias("pr_number"))


def linked_pulls(pulls: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, sha, pr_number): the pull that names a commit, else the one that its message names."""
    by_sha, by_message = pull_of_commit(pulls, commits), pull_of_message(commits, pulls)
    return by_sha.unionByName(by_message.join(by_sha.select("repo_id", "sha"), ["repo_id", "sha"], "left_anti"))


def link_pulls_and_issues(pulls: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with their link arrays: what is stored in them, and the closure of what their texts name (``issue_links``).

    An issue counts for a pull if it is known; a pull that an issue names is known, for the closure asks for it.
    """
    found = issue_links(pulls, issues)

    def grown(rows, name, key, value):
        made = link_arrays(found.withColumnRenamed(key, "number"), "number", value, "_found")
        both = F.array_sort(F.array_union(F.coalesce(name, F.array().cast("array<int>")), F.coalesce("_found", F.array().cast("array<int>"))))
        return rows.join(made, ["repo_id", "number"], "left").withColumn(name, both).select(*rows.columns)

    return grown(pulls, "linked_issue_numbers", "pr_number", "issue_number"), grown(issues, "linked_pr_numbers", "issue_number", "pr_number")


def resolve_reverts(commits: DataFrame) -> DataFrame:
    """(repo_id, sha, reverts_sha, how): by the named sha (prefix join), else by subject: the latest such commit before (as-of join)."""
    return dated_reverts(commits).drop("authored_date")


def dated_reverts(commits: DataFrame) -> DataFrame:
    """``resolve_reverts`` with the authored_date of each. What both joins find comes together in one aggregation."""
    maybe = commits.where(F.contains(F.lower("message"), F.lit("revert")))  # every form has the word; three joins read the rest
    reverts = maybe.select("repo_id", "sha", "authored_date", revert_target(F.col("message")).alias("target"), reverted_subject(F.col("message")).alias("subject")).where("target is not null or subject is not null")
    reverts = written(reverts, "reverts")
    named = commits.select("repo_id", F.col("sha").alias("of"), F.left("sha", F.lit(7)).alias("sha7"))
    by_sha = (
        reverts.where("target is not null").withColumn("sha7", F.left("target", F.lit(7))).join(named, ["repo_id", "sha7"])
        .where(F.startswith("of", "target") & (F.col("of") != F.col("sha")))
    )
    titled = commits.select("repo_id", first_line(F.col("message")).alias("subject"), F.col("sha").alias("of"), F.col("authored_date").alias("at"))
    by_subject = reverts.where("subject is not null").join(titled, ["repo_id", "subject"]).where("at < authored_date")
    found = lambda df, sha, subject: df.select("repo_id", "sha", "authored_date", sha.alias("by_sha"), subject.alias("by_subject"))
    no_sha, no_subject = F.lit(None).cast("string"), F.lit(None).cast("struct<at:timestamp,of:string>")
    every = found(by_sha, F.col("of"), no_subject).unionByName(found(by_subject, no_sha, F.struct("at", "of"))).unionByName(found(reverts, no_sha, no_subject))
    out = every.groupBy("repo_id", "sha").agg(F.max("authored_date").alias("authored_date"), F.min("by_sha").alias("by_sha"), F.max("by_subject")["of"].alias("by_subject"))
    how = F.when(F.col("by_sha").isNotNull(), "sha").when(F.col("by_subject").isNotNull(), "subject")
    return out.select("repo_id", "sha", F.coalesce("by_sha", "by_subject").alias("reverts_sha"), how.alias("how"), "authored_date")


def superseded(resolved: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, sha, superseded_by_sha): the latest commit that reverts each one. Dates that ``resolved`` has are not looked up."""
    dated = resolved.where("reverts_sha is not null")
    if "authored_date" not in resolved.columns:
        dated = dated.join(commits.select("repo_id", "sha", "authored_date"), ["repo_id", "sha"])
    return dated.groupBy("repo_id", F.col("reverts_sha").alias("target")).agg(F.max_by("sha", F.struct("authored_date", "sha")).alias("superseded_by_sha")).select("repo_id", F.col("target").alias("sha"), "superseded_by_sha")


def with_ends(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """``symbols`` with a missing end: the line before the next symbol of the file, or 50 lines after the last one's start."""
    after = F.lead("start_line").over(W.partitionBy(*keys).orderBy("start_line", "symbol_id")) - 1
    return symbols.withColumn("end_line", F.coalesce("end_line", after, F.col("start_line") + 50))


LINES_A_BUCKET = 64


def lines_to_symbols(lines: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """The innermost symbol of each line (``line_no``): start <= line <= end, the smallest span, then the earliest start.

    Lines are numbered by buckets of LINES_A_BUCKET and a symbol is looked up in the buckets of its span, so a line meets only
    the symbols near it, however long its file is.
    """
    bucket = lambda c: F.floor(F.col(c) / LINES_A_BUCKET)
    spans = with_ends(symbols, keys).where("end_line >= start_line")
    spans = spans.select(*keys, "symbol_id", "start_line", "end_line", F.explode(F.sequence(bucket("start_line"), bucket("end_line"))).alias("_b"))
    hit = lines.withColumn("_b", bucket("line_no")).join(spans, [*keys, "_b"]).where(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "start_line", "symbol_id")).alias("s")
    return hit.groupBy(*keys, "line_no").agg(best).select(*keys, "line_no", F.col("s.symbol_id").alias("symbol_id"))


def materialise_edges(commits: DataFrame, pulls: DataFrame, issues: DataFrame, whole_shas: bool = False) -> DataFrame:
    """Typed edges of the causal graph; of equal (source, target, type) the first label in order of priority stays.

    Commits go by seven characters of their shas, or by all of them: among millions of commits some share their first seven.
    """
    best = F.min(F.struct("_p", "label", "highlight")).alias("e")
    every = edge_rows(commits, pulls, issues, whole_shas)
    return every.groupBy("repo_id", "source_id", "target_id", "edge_type").agg(best).select("repo_id", "source_id", "target_id", "edge_type", "e.label", "e.highlight")


def edge_rows(commits: DataFrame, pulls: DataFrame, issues: DataFrame, whole_shas: bool = False) -> DataFrame:
    """The edges of ``materialise_edges`` with their priority ``_p``, before equal ones are made one: nothing is shuffled."""
    commit_key = lambda sha: F.concat(F.lit("commit:"), sha) if whole_shas else node_key("commit", sha)

    def edge(df, repo, source, target, kind, label, priority, highlight=False):
        return df.select(F.coalesce(repo, F.lit("")).alias("repo_id"), source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("edge_type"), F.lit(label).alias("label"), F.lit(highlight).alias("highlight"), F.lit(priority).alias("_p"))

    repo = F.col("repo_id")
    parts = [
        edge(issues.select("repo_id", "number", F.explode("linked_pr_numbers").alias("pr")), repo, node_key("issue", F.col("number")), node_key("pr", F.col("pr")), "resolves", "RESOLVED_BY_PR", 0),
        edge(pulls.select("repo_id", "number", F.explode("linked_issue_numbers").alias("i")), repo, node_key("issue", F.col("i")), node_key("pr", F.col("number")), "resolves", "RESOLVES_ISSUE", 1),
        edge(pulls.where("merge_commit_sha is not null"), repo, node_key("pr", F.col("number")), commit_key(F.col("merge_commit_sha")), "merges", "MERGES_COMMIT", 0),
        edge(commits.where("reverts_sha is not null"), repo, commit_key(F.col("sha")), commit_key(F.col("reverts_sha")), "reverts", "REVERTS_COMMIT", 0, True),
        edge(commits.where("superseded_by_sha is not null"), repo, commit_key(F.col("sha")), commit_key(F.col("superseded_by_sha")), "superseded_by", "SUPERSEDED_BY", 0, True),
        edge(commits.select("repo_id", "sha", F.explode("symbols_modified").alias("s")), repo, commit_key(F.col("sha")), node_key("symbol", F.col("s")), "modifies", "MODIFIES_SYMBOL", 0),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def symbol_alias(refs: DataFrame, symbols: DataFrame, column: str = "ref") -> DataFrame:
    """``refs`` with ``symbol_id``: by id, else by bare name, else by the last segment; the smallest id of equals."""
    by = lambda key: symbols.groupBy(key.alias("_k")).agg(F.min("symbol_id").alias("_s"))
    out = refs
    keys = (F.col("symbol_id"), F.col("symbol_name"), F.element_at(F.split("symbol_id", ":"), -1))
    wanted = (F.col(column), F.col(column), F.element_at(F.split(column, ":"), -1))
    for i, (k, w) in enumerate(zip(keys, wanted)):
        side = by(k).select(F.col("_k").alias(f"_k{i}"), F.col("_s").alias(f"_s{i}"))
        out = out.join(side, w == F.col(f"_k{i}"), "left")
    return out.select(*refs.columns, F.coalesce("_s0", "_s1", "_s2").alias("symbol_id"))


# fixed values: words that no candidate symbol is looked up for
CANDIDATE_STOPWORDS = frozenset(
    "what when where which does from with this that have been were commit commits pull request issue repository history code "
    "file method function class architecture handle using".split()
)


def known_shas(refs: DataFrame, commits: DataFrame, repo_id: str | None = None) -> DataFrame:
    """The rows of ``refs`` (ref) of seven characters or more that begin the sha of a commit of the tenant."""
    own = commits.where(tenant_match(F.col("repo_id"), repo_id, alias=True)).select("sha", F.lower(F.left("sha", F.lit(7))).alias("_7"))
    short = refs.where(F.length("ref") >= 7).withColumn("_7", F.lower(F.left("ref", F.lit(7))))
    return short.join(own, (short["_7"] == own["_7"]) & F.startswith(F.lower(own["sha"]), F.lower(short["ref"])), "left_semi").drop("_7")


def known_numbers(refs: DataFrame, pulls: DataFrame, issues: DataFrame, repo_id: str | None = None) -> DataFrame:
    """The rows of ``refs`` (ref, text) that are the number of a pull or an issue of the tenant.

    A hash goes with each number: adaptive execution deals tasks by bytes, and numbers alone compress so well that a task would
    get many times the rows that its bytes promise.
    """
    own = lambda df: df.where(tenant_match(F.col("repo_id"), repo_id, alias=True)).select(F.col("number").alias("_n"))
    numbers = own(pulls).union(own(issues)).withColumn("_h", F.xxhash64("_n"))
    asked = refs.withColumn("_n", F.trim("ref").try_cast("int")).where("_n is not null").withColumn("_h", F.xxhash64("_n"))
    return asked.join(numbers, ["_n", "_h"], "left_semi").select(*refs.columns)


def candidate_symbols(texts: DataFrame, symbols: DataFrame, repo_id: str | None = None, limit: int = 8) -> DataFrame:
    """(text_id, symbol_id, symbol_name, file_path, kind) of ``texts`` (text_id, text): symbols whose name or file holds a word
    of the text, up to ``limit`` for each text, by the word's place, then by id.

    The texts are questions of users, few beside the symbols: their words are broadcast while they are under WORDS_MOST.
    """
    every = F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0))
    words = texts.select("text_id", F.posexplode(F.array_distinct(F.transform(every, F.lower))).alias("pos", "word")).where(~F.col("word").isin(*CANDIDATE_STOPWORDS))
    small = words.limit(WORDS_MOST + 1).count() <= WORDS_MOST
    own = symbols.where(tenant_match(F.col("repo_id"), repo_id, alias=True))
    holds = F.contains(F.lower("symbol_name"), F.col("word")) | F.contains(F.lower("file_path"), F.col("word"))
    if small:
        hit = own.join(F.broadcast(words), holds)
    else:  # a word is held only where its first four characters are: those are an equi key
        grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1))), lambda i: F.lower(F.substr(F.col(c), i, F.lit(4))))
        keyed = own.withColumn("_g", F.explode(F.array_union(grams("symbol_name"), grams("file_path"))))
        hit = keyed.join(words.withColumn("_g", F.left("word", F.lit(4))), "_g").where(holds)
    first = hit.groupBy("text_id", "symbol_id").agg(F.min(F.struct("pos", "symbol_name", "file_path", "kind")).alias("s"))
    order = W.partitionBy("text_id").orderBy("s.pos", "symbol_id")
    return first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).select("text_id", "symbol_id", "s.symbol_name", "s.file_path", "s.kind")


WORDS_MOST = 10_000


def candidate_forensics(texts: DataFrame, pulls: DataFrame, issues: DataFrame, commits: DataFrame, symbols: DataFrame, repo_id: str | None = None) -> DataFrame:
    """(text_id, evidence): what the first four #N, the first three shas and up to six symbols of ``texts`` (text_id, text) name; a #N is no sha."""
    own = lambda df: df.where(tenant_match(F.col("repo_id"), repo_id, alias=True))
    first = lambda pattern, group, n: F.explode(F.slice(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), 1, n))
    numbers = texts.select("text_id", first(r"#(\d+)", 1, 4).alias("n")).select("text_id", F.col("n").try_cast("int").alias("number"))
    titles = lambda df, name: own(df).groupBy("number").agg(F.min("title").alias(name))
    named = numbers.join(titles(pulls, "p"), "number", "left").join(titles(issues, "i"), "number", "left")
    tag = lambda kind, title: F.concat(F.lit(f"{kind} #"), F.col("number").cast("string"), F.lit(": "), F.col(title))
    out = named.where("p is not null").select("text_id", tag("Pull Request", "p").alias("evidence"))
    out = out.unionByName(named.where("i is not null and (p is null or p != i)").select("text_id", tag("Issue", "i").alias("evidence")))
    shas = texts.select("text_id", first(r"(?<!#)\b[0-9a-fA-F]{7,40}\b", 0, 3).alias("ref")).withColumn("ref", F.lower("ref")).withColumn("_7", F.left("ref", F.lit(7)))
    known = own(commits).select("sha", "message", F.lower(F.left("sha", F.lit(7))).alias("_7"))
    hit = shas.join(known, "_7").where(F.startswith("sha", "ref")).groupBy("text_id", "ref").agg(F.min(F.struct("sha", "message")).alias("c"))
    line = F.concat(F.lit("Commit "), F.left("c.sha", F.lit(7)), F.lit(": "), F.coalesce(F.substring_index("c.message", "\n", 1), F.lit("")))
    found = candidate_symbols(texts, symbols, repo_id, 6)
    symbol = F.concat(F.lit("Symbol: "), "symbol_name", F.lit(" ("), "kind", F.lit(" in "), "file_path", F.lit(")"))
    return out.unionByName(hit.select("text_id", line.alias("evidence"))).unionByName(found.select("text_id", symbol.alias("evidence"))).distinct()


def related_discussion(refs: DataFrame, commits: DataFrame, pulls: DataFrame, issues: DataFrame, chunks: DataFrame, repo_id: str | None = None) -> DataFrame:
    """(ref, kind, key) of ``refs`` (ref): what a sha, or the number of a pull or an issue, is linked with, itself included.

    A sha leads to the pulls and issues that its chunks relate to. A number leads over the link arrays of its pull and issue to
    issues, pulls and commits; without linked commits, to those whose message names the number as a whole word. Seven digits or
    more are a number if a pull or an issue has it, else a sha.
    """
    own = lambda df: df.where(tenant_match(F.col("repo_id"), repo_id, alias=True))
    commits, pulls, issues, chunks = own(commits), own(pulls), own(issues), own(chunks)
    taken = pulls.select("number").union(issues.select("number")).where("number >= 1000000").select(F.col("number").cast("string").alias("_r")).distinct().withColumn("_taken", F.lit(True))
    asked = refs.select("ref", F.lower(F.trim("ref")).alias("_r")).distinct().join(taken, "_r", "left")
    is_sha = F.col("_r").rlike("^[0-9a-f]{7,40}$") & F.col("_taken").isNull()
    row = lambda df, kind, key: df.select("ref", "repo_id", F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    by7 = commits.select("repo_id", "sha", F.lower(F.left("sha", F.lit(7))).alias("_7"))
    shas = asked.where(is_sha).withColumn("_7", F.left("_r", F.lit(7))).join(by7, "_7").where(F.startswith("sha", "_r"))
    shas = shas.groupBy("ref").agg(F.min(F.struct("sha", "repo_id")).alias("c")).select("ref", "c.sha", "c.repo_id")
    related = chunks.where("source_type = 'commit'").select("repo_id", F.col("source_id").alias("sha"), F.explode("related_ids").alias("rel"))
    related = shas.join(related, ["repo_id", "sha"]).select("ref", "repo_id", F.regexp_extract("rel", r"^(pr|issue)#\d+$", 1).alias("k"), F.regexp_extract("rel", r"^(?:pr|issue)#(\d+)$", 1).try_cast("int").alias("number"))
    numbers = asked.where(~is_sha).select("ref", F.regexp_extract("_r", r"\d+", 0).try_cast("int").alias("number")).where("number is not null")
    mine = lambda df, links: numbers.join(df.select("repo_id", "number", links, F.col("linked_commit_shas").alias("shas")), "number")
    p, i = mine(pulls, F.col("linked_issue_numbers").alias("to")), mine(issues, F.col("linked_pr_numbers").alias("to"))
    to = lambda df: df.select("ref", "repo_id", F.explode("to").alias("number"))
    exist = lambda df, there: df.join(there.select("repo_id", "number").distinct(), ["repo_id", "number"], "left_semi")
    all_pulls = p.select("ref", "repo_id", "number").unionByName(exist(to(i), pulls)).unionByName(exist(related.where("k = 'pr'").drop("k"), pulls))
    all_issues = i.select("ref", "repo_id", "number").unionByName(exist(to(p), issues)).unionByName(exist(related.where("k = 'issue'").drop("k"), issues))
    both = p.drop("to").unionByName(i.drop("to"))
    linked = both.select("ref", "repo_id", F.explode("shas").alias("sha")).join(commits.select("repo_id", "sha"), ["repo_id", "sha"], "left_semi")
    said = commits.select("repo_id", "sha", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("message", F.lit("")), F.lit(r"#(\d+)\b"), F.lit(1)))).alias("n"))
    said = said.select("repo_id", "sha", F.col("n").try_cast("int").alias("number"))
    spoken = both.where(F.size("shas") <= 0).select("ref", "repo_id", "number").join(said, ["repo_id", "number"]).select("ref", "repo_id", "sha")
    found = row(shas, "commit", F.col("sha")).unionByName(row(linked.unionByName(spoken), "commit", F.col("sha")))
    return found.unionByName(row(all_pulls, "pr", F.col("number"))).unionByName(row(all_issues, "issue", F.col("number"))).select("ref", "kind", "key").distinct()
