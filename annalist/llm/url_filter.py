"""URL filters by empirical-Bayes host reputation, in DataFrame expressions only.

Curated rules decide first. Every other page gets the verdict of its host's reputation: labelled page outcomes
(1 good, 0 bad) are counted by host, and each host's rate of good pages is shrunk through beta-binomial priors from
host to registered domain to public suffix to the whole corpus. The strength of the prior of each level is estimated
from the over-dispersion of the counts (method of moments). A host is blocked only when the upper bound of its
posterior is below ``threshold``, so that few labels never block a host.

Shuffles carry one pre-aggregated row per host; pages meet reputations by an equi-join on the host, which adaptive
execution broadcasts when the reputations are small and splits where one host holds many pages.

Defined results: a null url, or one without ``://``, has an empty host and path, matches no rule and has the
verdict of the empty host; null outcomes are ignored; a page labelled more than once counts once per label;
without any labels the prior mean is 1/2 and nothing is blocked by reputation; an empty table gives an empty result;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import written

# fixed values: the rules of the contract, and public suffixes of two labels
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "com.br", "co.in", "co.nz", "com.cn", "com.mx", "co.za", "co.kr")


@dataclass(frozen=True)
class Reputation:
    threshold: float = 0.5  # hosts surely below this share of good pages are blocked
    deviations: float = 2.0  # posterior standard deviations of the upper bound
    least_strength: float = 0.5  # limits of a prior's strength, in pages
    most_strength: float = 1000.0


def parse(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        at, _, under = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{under}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> Column:
    """Registered domain: the public suffix and one label more."""
    return F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def _shrunk(units: DataFrame, key: str, mean: str, out: str, how: Reputation) -> DataFrame:
    """``units`` (key, n, k, prior mean) with the prior strength of the level and the posterior mean ``out``."""
    m = F.col(mean)
    spread = F.sum(F.pow(F.col("k") - F.col("n") * m, 2)) - F.sum(F.col("n") * m * (1 - m))
    scale = F.sum(F.col("n") * m * (1 - m) * (F.col("n") - 1))
    rho = F.greatest(F.least(F.coalesce(spread / F.nullif(scale, F.lit(0.0)), F.lit(0.0)), F.lit(1 / (1 + how.least_strength))), F.lit(1 / (1 + how.most_strength)))
    strength = units.agg((1 / rho - 1).alias(f"_s_{out}"))  # one row
    return units.crossJoin(F.broadcast(strength)).withColumn(out, (F.col("k") + F.col(f"_s_{out}") * m) / (F.col("n") + F.col(f"_s_{out}")))


def reputations(labelled: DataFrame, hosts: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """Per host of ``hosts`` (host) its labels and posterior.

    ``labelled`` has (host, outcome, pages): so many pages of the host with that outcome, in one row or several; the
    result (host, n, k, prior_mean, strength, mean, upper).
    """
    n, k = F.sum("pages").cast("double"), F.sum(F.col("outcome") * F.col("pages")).cast("double")
    by_host = labelled.where(F.col("outcome").isNotNull()).groupBy("host").agg(n.alias("n"), k.alias("k"))
    units = hosts.select("host").distinct().join(by_host, "host", "left").fillna(0.0, ["n", "k"]).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    units = written(units, "hosts")  # read once for each level of the priors
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    total = units.agg(((F.coalesce(F.sum("k"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("m0"))  # one row
    suffixes = _shrunk(units.groupBy("suffix").agg(*sums).crossJoin(F.broadcast(total)), "suffix", "m0", "m1", how)
    suffixes = written(suffixes, "suffixes")
    domains = _shrunk(units.groupBy("domain", "suffix").agg(*sums).join(suffixes.select("suffix", "m1"), "suffix"), "domain", "m1", "m2", how)
    domains = written(domains, "domains")
    found = _shrunk(units.join(domains.select("domain", "m2"), "domain"), "host", "m2", "mean", how)
    size = F.col("n") + F.col("_s_mean")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))
    return found.select("host", "n", "k", F.col("m2").alias("prior_mean"), F.col("_s_mean").alias("strength"), "mean", F.least(F.lit(1.0), F.col("mean") + how.deviations * deviation).alias("upper"))


def outcomes_by_host(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(host, outcome, pages) of page outcomes (page_id, outcome): 1 for a page known to be good, 0 for a bad one."""
    parsed = pages.select(F.col(id_col).alias("page_id"), parse(F.col(url_col))[0].alias("host"))
    known = outcomes.select(F.col("page_id").alias("_page"), "outcome")
    return parsed.join(known, F.col("page_id") == F.col("_page")).groupBy("host", "outcome").agg(F.count(F.lit(1)).alias("pages"))


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, how: Reputation = Reputation(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page (id, host, path, rule, verdict, upper): the rule's verdict, else that of the host's reputation.

    ``labelled`` has (host, outcome, pages), as ``outcomes_by_host`` or ``article_outcomes`` give it.
    """
    host, path = parse(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    found = reputations(labelled, parsed, how).select(F.col("host").alias("_host"), "upper")
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("upper") < how.threshold, "block").otherwise("allow")
    return parsed.join(found, F.col("host") == F.col("_host"), "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "upper")


def article_digest(html: Column) -> Column:
    """Digest of a page's article text without its heading, or null: matches ``text_digest`` of the text it was made from."""
    body = F.regexp_extract(html, r"(?s)</h1>(.*)</article>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        body = F.regexp_replace(body, r"<[^>]*>", " ") if entity == "&lt;" else body
        body = F.replace(body, F.lit(entity), F.lit(char))
    return F.when(F.length(body) > 0, text_digest(body))


def text_digest(text: Column) -> Column:
    return F.md5(F.trim(F.regexp_replace(text, r"[ \t\n\x0b\f\r]+", " ")))


def article_outcomes(pages: DataFrame, documents: DataFrame, labels: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, outcome, pages) of the pages whose article is the text of a labelled document: the majority of its labels.

    Pages are counted by digest and host before the join, so an article that a third of all pages carry is one row a host.
    """
    known = (
        documents.select("doc_id", text_digest(F.col("text")).alias("digest"))  # before the shuffle, which carries no texts
        .join(labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), "quality"), F.col("doc_id") == F.col("_id"))
        .groupBy("digest")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("outcome"))
    )
    articles = pages.select(parse(F.col(url_col))[0].alias("host"), article_digest(F.col(html_col)).alias("_digest")).where("_digest is not null")
    counted = articles.groupBy("_digest", "host").agg(F.count(F.lit(1)).alias("pages"))
    return counted.join(known, F.col("_digest") == F.col("digest")).select("host", "outcome", "pages")
