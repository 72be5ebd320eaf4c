"""Rule-based verification of claims against the recorded evidence. Drafts and evidence are tables; every rule is a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.storage import written

FAST_PASS = 0.70
# fixed values: words that look like shas, and the patterns of the rules
HEX_WORDS = (
    "acceded", "cabbed", "dabbed", "deafened", "debrief", "decaf", "deface", "defaced", "efface", "effaced", "facade", "facaded", "feedback", "scaffold",
)
CITED_SHA = r"(?<![0-9a-fA-FxX])([0-9a-fA-F]{7,40})\b"
NAMED_SHA = r"(?i)\bcommit\s+`?([0-9a-fA-F]{7,40})`?\b"
CITED_NUMBER = r"(?i)(?:PR|Pull\s+Request|Issue|#)\s*#?(\d+)"
ACTIVE = r"(?i)(?:commit\s+)?`?([0-9a-fA-F]{7,40})`?\s+(?:reverted|reverts|undid)\s+(?:the\s+changes\s+in\s+)?(?:commit\s+)?`?([0-9a-fA-F]{7,40})`?"
PASSIVE = r"(?i)(?:commit\s+)?`?([0-9a-fA-F]{7,40})`?\s+was\s+(?:reverted|superseded|undone)\s+by\s+(?:commit\s+)?`?([0-9a-fA-F]{7,40})`?"
BEFORE = r"(?i)(?:commit\s+)?`?([0-9a-fA-F]{7,40})`?\s+(?:preceded|came\s+before|occurred\s+before|was\s+committed\s+before)\s+(?:commit\s+)?`?([0-9a-fA-F]{7,40})`?"
MODIFIES = (
    r"(?i)\b(?:modified|modifies|changed|changes|updated|updates|added|adds|"
    r"introduced|introduces|refactored|refactors|removed|removes|deleted|deletes|"
    r"implemented|implements|fixed|fixes|touched|touches|patched|patches)\b"
)
FILE_TOKEN = r"\b([A-Za-z0-9_./\\-]+\.(?:py|js|ts|tsx|jsx|go|rs|java|c|cpp|h|hpp|rb|php|cs|swift|kt|scala|sql|sh|toml|yaml|yml|json))\b"
CLAUSES = r"(?i)(?:(?:\.(?=\s|$)|[;\n])+|\s*,\s*(?:while|whereas|and\s+commit|but\s+commit)\s+)"
SYMBOL_TOKEN = r"`([A-Za-z_][A-Za-z0-9_.:]{2,})`"
QUOTED_IDENTIFIER = r"`([A-Za-z_][A-Za-z0-9_.()]{2,})`"
SNAKE_IDENTIFIER = r"\b([a-z][a-z0-9]*_[a-z0-9_]{2,})\b"


def sha7(s: Column) -> Column:
    return F.lower(F.left(s, F.lit(7)))


def _every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def cited_shas(text: Column) -> Column:
    """Seven-character shas of a text: hex words of digits and letters or of 40 characters, and those that follow "commit";
    not numbers, nor 0x literals, nor English words."""
    named = F.filter(F.transform(_every(text, NAMED_SHA), F.lower), lambda s: s.rlike("[a-f]"))
    found = F.transform(_every(text, CITED_SHA), F.lower)
    english = lambda s: s.isin(*HEX_WORDS) & ~F.array_contains(named, s)
    mixed = lambda s: s.rlike("[a-f]") & (s.rlike("[0-9]") | (F.length(s) == 40) | F.array_contains(named, s))
    return F.array_distinct(F.transform(F.filter(found, lambda s: mixed(s) & ~english(s)), lambda s: F.left(s, F.lit(7))))


def cited_numbers(text: Column) -> Column:
    """Numbers of "PR 12", "Pull Request #12", "Issue 12" and "#12"."""
    return F.array_distinct(F.array_compact(F.transform(_every(text, CITED_NUMBER), lambda n: n.try_cast("int"))))


def evidence_index(commits: DataFrame, chunks: DataFrame, pulls_of_commits: DataFrame | None = None) -> DataFrame:
    """Per sha7: files, symbols, pulls, what it reverts and what superseded it, its date and the text of its chunks."""
    own = commits.groupBy(sha7(F.col("sha")).alias("sha7")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("files_changed")))).alias("files"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("symbols_modified")))).alias("symbols"),
        F.min(sha7(F.col("reverts_sha"))).alias("reverts"), F.min(sha7(F.col("superseded_by_sha"))).alias("superseded_by"), F.min("authored_date").alias("date"),
    )
    texts = chunks.where(F.col("source_type") == "commit").groupBy(sha7(F.col("source_id")).alias("sha7")).agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    out = own.join(texts, "sha7", "left")
    if pulls_of_commits is None:
        return out.withColumn("prs", F.array().cast("array<int>"))
    prs = pulls_of_commits.groupBy(sha7(F.col("sha")).alias("sha7")).agg(F.array_sort(F.collect_set("pr_number")).alias("prs"))
    return out.join(prs, "sha7", "left").withColumn("prs", F.coalesce("prs", F.array().cast("array<int>")))


def _base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_token(text: Column) -> Column:
    return F.lower(F.translate(F.btrim(text, F.lit("`'\".,;:()[] ")), "\\", "/"))


def file_matches(token: Column, files: Column, text: Column) -> Column:
    """Equal, a path suffix either way, the same base name, or named in the text."""
    low, base = file_token(token), _base(file_token(token))
    fits = lambda f: (f == low) | F.endswith(f, F.concat(F.lit("/"), low)) | F.endswith(low, F.concat(F.lit("/"), f)) | (_base(f) == base)
    return F.coalesce(F.exists(files, lambda f: fits(F.lower(f))), F.lit(False)) | F.coalesce(F.contains(F.lower(text), base), F.lit(False))


def symbol_parts(symbol: Column) -> Column:
    """A symbol's whole name, what follows its file, and the segments of that."""
    low = F.lower(F.btrim(symbol, F.lit("`'\"() ")))
    own = F.element_at(F.split(low, ":"), -1)
    segments = F.filter(F.split(own, r"[.:]+"), lambda p: F.length(p) > 1)
    return F.array_distinct(F.filter(F.concat(F.array(low, own), segments), lambda p: p != ""))


def symbol_matches(token: Column, symbols: Column, text: Column) -> Column:
    """A part in common, or the symbol or its last segment in the text."""
    low = F.lower(F.btrim(token, F.lit("`'\"()")))
    short = F.element_at(F.split(F.element_at(F.split(low, ":"), -1), r"\."), -1)
    shared = F.coalesce(F.arrays_overlap(F.flatten(F.transform(symbols, symbol_parts)), symbol_parts(token)), F.lit(False))
    return shared | F.coalesce(F.contains(F.lower(text), low) | (short != "") & F.contains(F.lower(text), short), F.lit(False))


def _pairs(drafts: DataFrame, pattern: str) -> DataFrame:
    one, two = (F.regexp_extract_all("draft", F.lit(pattern), F.lit(i)) for i in (1, 2))
    return drafts.select("draft_id", F.explode(F.arrays_zip(one.alias("a"), two.alias("b"))).alias("p")).select("draft_id", sha7(F.col("p.a")).alias("a"), sha7(F.col("p.b")).alias("b"))


def _error(df: DataFrame, rule: str, *parts) -> DataFrame:
    return df.select("draft_id", F.lit(rule).alias("rule"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("message"))


def citations(drafts: DataFrame, evidence: DataFrame, pulls: DataFrame, issues: DataFrame, commits: DataFrame) -> DataFrame:
    """(draft_id, ref, known): the cited numbers (#N) and shas of drafts (draft_id, draft), and whether they are recorded."""
    shas = drafts.select("draft_id", F.explode(cited_shas(F.col("draft"))).alias("ref"))
    numbers = drafts.select("draft_id", F.explode(F.transform(cited_numbers(F.col("draft")), lambda n: F.concat(F.lit("#"), n.cast("string")))).alias("ref"))
    number = lambda df: df.select(F.concat(F.lit("#"), F.col("number").cast("string")).alias("ref"))
    commit = evidence.select(F.col("sha7").alias("ref")).union(commits.select(sha7(F.col("sha"))))
    known = commit.union(number(pulls)).union(number(issues)).distinct().withColumn("_known", F.lit(True))
    return shas.union(numbers).join(known, "ref", "left").select("draft_id", "ref", F.coalesce("_known", F.lit(False)).alias("known"))


def claim_errors(drafts: DataFrame, evidence: DataFrame, pulls: DataFrame, issues: DataFrame, commits: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """(draft_id, rule, message) of ``drafts`` (draft_id, draft): unknown references, inverted reverts, misattributed files and
    symbols, and wrong chronology. ``cited`` are the citations of the drafts, where they have been looked up already.

    Wrong files and symbols are written before their owners are looked for among all evidence, which is not read without any.
    """
    unknown = (citations(drafts, evidence, pulls, issues, commits) if cited is None else cited).where("not known")
    errors = _error(unknown, "provenance", "unknown reference ", F.col("ref"))
    side = lambda name: evidence.select(F.col("sha7").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("reverts", "superseded_by", "date")))
    claimed = _pairs(drafts, ACTIVE).unionByName(_pairs(drafts, PASSIVE).select("draft_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = claimed.join(side("a"), "a", "left").join(side("b"), "b", "left")
    inverted = F.coalesce(F.col("b_reverts") == F.col("a"), F.lit(False)) | F.coalesce(F.col("a_superseded_by") == F.col("b"), F.lit(False))
    errors = errors.unionByName(_error(both.where(inverted), "revert inversion", F.col("b"), " reverts ", F.col("a"), ", not the other way round"))
    errors = errors.unionByName(_error(both.where(~inverted & (F.col("a_reverts") != F.col("b"))), "revert mismatch", F.col("a"), " reverts ", F.col("a_reverts"), ", not ", F.col("b")))
    clauses = drafts.select("draft_id", F.posexplode(F.split("draft", CLAUSES)).alias("n", "clause"))
    order = _pairs(clauses.withColumnRenamed("clause", "draft"), BEFORE).join(side("a"), "a").join(side("b"), "b").where("a_date > b_date")
    errors = errors.unionByName(_error(order, "chronology", F.col("a"), " is not before ", F.col("b")))
    subjects = clauses.where(F.col("clause").rlike(MODIFIES)).withColumn("sha7", F.explode(cited_shas(F.col("clause")))).join(evidence, "sha7")
    alone = subjects.groupBy("draft_id", "n").agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in ("clause", "sha7", "files", "symbols", "text"))).where("_n = 1")
    token = lambda pattern: F.explode(F.array_distinct(_every(F.col("clause"), pattern))).alias("token")
    files = alone.where(F.size("files") > 0).select("draft_id", "sha7", "files", "text", token(FILE_TOKEN))
    wrong = files.where(~file_matches(F.col("token"), F.col("files"), F.col("text"))).withColumn("base", _base(file_token(F.col("token"))))
    wrong = written(wrong.select("draft_id", "sha7", "token", "base"), "wrong")
    if not wrong.isEmpty():
        elsewhere = evidence.select(F.col("sha7").alias("other"), F.explode("files").alias("f")).select("other", _base(F.lower("f")).alias("base"))
        moved = wrong.join(elsewhere, "base").where("other != sha7").select("draft_id", "sha7", "token").distinct()
        errors = errors.unionByName(_error(moved, "misattribution", F.col("token"), " is not in the footprint of ", F.col("sha7")))
    symbols = alone.where(F.size("symbols") > 0).select("draft_id", "sha7", "symbols", "text", token(SYMBOL_TOKEN)).where(~F.col("token").rlike("^" + FILE_TOKEN) & (sha7(F.col("token")) != F.col("sha7")))
    wrong = symbols.where(~symbol_matches(F.col("token"), F.col("symbols"), F.col("text"))).withColumn("part", F.explode(symbol_parts(F.col("token"))))
    wrong = written(wrong.select("draft_id", "sha7", "token", "part"), "wrong")
    if wrong.isEmpty():
        return errors.distinct()
    owners = evidence.select(F.col("sha7").alias("other"), F.explode(F.array_distinct(F.flatten(F.transform("symbols", symbol_parts)))).alias("part"))
    moved = wrong.join(owners, "part").where("other != sha7").select("draft_id", "sha7", "token").distinct()
    return errors.unionByName(_error(moved, "symbol misattribution", F.col("token"), " is not a symbol of ", F.col("sha7"))).distinct()


def identifiers(draft: Column) -> Column:
    """Code identifiers of a text, lower-cased: in backticks, or in snake case; no shas and no numbers of pulls or issues."""
    found = F.transform(F.concat(_every(draft, QUOTED_IDENTIFIER), _every(draft, SNAKE_IDENTIFIER)), lambda t: F.lower(F.btrim(t, F.lit("`'\"().,;:"))))
    return F.array_distinct(F.filter(found, lambda t: (t != "") & ~t.rlike(r"^(?:pr|issue)#?\d+$") & ~F.array_contains(cited_shas(draft), F.left(t, F.lit(7)))))


def grounding(drafts: DataFrame, evidence_text: DataFrame) -> DataFrame:
    """(draft_id, grounded, named, invented): how many identifiers of a draft its evidence (draft_id, evidence) or question
    knows, and up to three of the others that look like code, where there is any evidence."""
    question = F.col("question") if "question" in drafts.columns else F.lit("")
    rows = drafts.select("draft_id", identifiers(F.col("draft")).alias("names"), F.lower(F.coalesce(question, F.lit(""))).alias("q")).join(evidence_text, "draft_id", "left")
    rows = rows.withColumn("e", F.lower(F.coalesce("evidence", F.lit(""))))
    held = lambda x: F.contains(F.col("e"), x) | F.contains(F.col("q"), x)
    parts = lambda t: F.filter(F.split(t, "[_.:/]"), lambda p: F.length(p) > 2)
    known = lambda t: held(t) | held(F.element_at(F.split(F.element_at(F.split(t, "::"), -1), r"\."), -1)) | (F.size(parts(t)) > 1) & F.forall(parts(t), held)
    invented = F.when(F.col("e") != "", F.slice(F.filter("names", lambda t: ~known(t) & t.rlike("[_.]") & (F.length(t) > 5)), 1, 3)).otherwise(F.array().cast("array<string>"))
    return rows.select("draft_id", F.size(F.filter("names", known)).alias("grounded"), F.size("names").alias("named"), invented.alias("invented"))


def verdicts(drafts: DataFrame, errors: DataFrame, grounded: DataFrame, cited: DataFrame) -> DataFrame:
    """(draft_id, passed, fast_pass, score): no errors and nothing invented; and a known citation and a score of FAST_PASS."""
    n_errors = errors.groupBy("draft_id").agg(F.count(F.lit(1)).alias("n_errors"))
    n_known = cited.where("known").groupBy("draft_id").agg(F.count(F.lit(1)).alias("verified"))
    rows = drafts.select("draft_id", (F.trim("draft") == "").alias("empty")).join(n_errors, "draft_id", "left").join(n_known, "draft_id", "left")
    rows = rows.join(grounded, "draft_id", "left").fillna(0, ["n_errors", "verified", "grounded", "named"])
    total = F.col("named") + F.col("verified")
    score = F.when(F.col("empty"), 0.0).when(total == 0, 1.0).otherwise((F.col("grounded") + F.col("verified")) / total)
    passed = ~F.col("empty") & (F.col("n_errors") == 0) & (F.coalesce(F.size("invented"), F.lit(0)) == 0)
    return rows.select("draft_id", passed.alias("passed"), (passed & (F.col("verified") >= 1) & (score >= FAST_PASS)).alias("fast_pass"), F.bround(score, 4).alias("score"))


def hydrate(chunks: DataFrame, pulls: DataFrame, issues: DataFrame, top: int = 5, most: int = 3) -> DataFrame:
    """(ref, score): pulls, else issues, that the best chunks relate to and that are not among them, at 0.9 of the score."""
    best = chunks.orderBy(F.desc("score"), "id").limit(top)
    refs = best.select("score", F.explode("related_ids").alias("r")).select("score", F.lower(F.regexp_extract("r", r"(?i)^(pr|issue)", 1)).alias("kind"), F.regexp_extract("r", r"#(\d+)$", 1).cast("int").alias("number")).where("kind != '' and number is not null")
    present = chunks.where(F.col("source_type").isin("pr", "issue")).select(F.col("source_id").cast("int").alias("number")).distinct()
    known = pulls.select("number", F.lit(0).alias("o"), F.lit("pr").alias("k")).unionByName(issues.select("number", F.lit(1).alias("o"), F.lit("issue").alias("k"))).groupBy("number").agg(F.min_by("k", "o").alias("k"))
    found = refs.join(present, "number", "left_anti").groupBy("number").agg(F.max("score").alias("parent")).join(known, "number")
    return found.select(F.concat("k", F.lit("#"), F.col("number").cast("string")).alias("ref"), F.greatest(F.lit(0.012), F.bround(0.9 * F.col("parent"), 6)).alias("score")).orderBy(F.desc("score"), "ref").limit(most)


def guardrail(answer: str, errors: list[str], missing: list[str]) -> str:
    """The answer with the links it should have named and a note on references that nothing supports."""
    out = answer
    if missing:
        out += "\n\nRelated: " + ", ".join(sorted(missing))
    if errors:
        out += "\n\nUnverified: " + "; ".join(sorted(errors))
    return out


def escape_evidence(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)<(/?)evidence", "&lt;$1evidence")
