"""Block and allow rules for urls, spread over redirects and canonical links. DataFrame operations only."""

from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspan.llm.cluster import checkpoint
from driftspan.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block) for a host, its subdomains and a path's beginning."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(text: str) -> list[Rule]:
    """Rules from 'allow com/, block net/es/'."""
    rules = []
    for part in filter(None, map(str.strip, text.split(","))):
        verdict, where = part.split()
        host, slash, path = where.partition("/")
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {part}")
        rules.append(Rule(verdict, host.lower(), slash + path))
    return rules


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    known = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(known, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(known, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct(rule, verdict) of the longest rule that fits, or nulls."""
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    shortest_first = sorted(rules, key=lambda r: len(r.text))
    return reduce(lambda rest, r: F.when(fits(r), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(rest), shortest_first, none)


def node_key(url: Column) -> Column:
    """What aliases are told apart by: the url without scheme and fragment, host lower-cased; null without a host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query))


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.trim(F.btrim(value, F.lit("\"'")))


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """a, b: keys of a page and of where its canonical links and refresh redirects lead, absolute or relative."""
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    rows = pages.select(F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|http-equiv"))
    rows = rows.select("url", F.explode(tags).alias("tag")).where(F.col("tag").rlike("(?i)canonical|refresh")).distinct()
    canonical = F.when(F.lower(_attribute(F.col("tag"), "rel")).rlike(r"(^|\s)canonical(\s|$)"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*[\"']?([^\"']*)", 1))
    target = F.regexp_replace(F.trim(F.coalesce(canonical, refresh)), "&amp;", "&")
    scheme, site = F.regexp_extract("url", r"^(.*?)://", 1), F.regexp_extract("url", r"^(.*?://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract("url", r"^(.*?://[^/?#]*/(?:[^?#]*/)?)", 1), F.lit("")), F.concat(site, F.lit("/")))
    absolute = F.when(F.col("to").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.col("to")).when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), F.col("to"))).when(F.col("to").startswith("/"), F.concat(site, F.col("to")))
    absolute = absolute.when(F.col("to").startswith("?"), F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.col("to"))).when(F.col("to").rlike("^(#|[a-zA-Z][a-zA-Z0-9+.-]*:)"), F.lit(None)).otherwise(F.concat(folder, F.col("to")))
    found = rows.select("url", target.alias("to")).where("to <> ''").distinct().select("url", absolute.alias("to")).distinct()
    links = found.select(node_key(F.col("url")).alias("a"), node_key(F.col("to")).alias("b"))
    return checkpoint(links.distinct()).where("a is not null and b is not null and a <> b")  # kept first: a filter would repeat the parsing


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, a row for each row of pages.

    A page that a rule fits has the rule's verdict. Any other takes part in what its aliases are given: pages and
    link targets are joined into components by redirects and canonical links; where a member is explicitly allowed
    the component is allowed, else where one is blocked it is blocked. Without either, the default holds.
    """
    links = alias_links(pages, url, html)
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    source = source.select("page_id", host.alias("host"), path.alias("path"), node_key(F.col("url")).alias("key"))
    judged = source.withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    if links.isEmpty():
        return judged.select("page_id", "host", "path", "own.rule", F.coalesce("own.verdict", F.lit(default)).alias("verdict"))
    nodes = connected_components(links)
    node_host, node_path = host_and_path(F.concat(F.lit("x://"), F.col("node")))
    ruled = nodes.select("component", node_host.alias("host"), node_path.alias("path")).withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    given = ruled.groupBy("component").agg(F.max(F.col("own.verdict") == "allow").alias("allowed"), F.max(F.col("own.verdict") == "block").alias("blocked"))
    verdict = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    spread = nodes.join(given, "component").select("node", verdict.alias("spread"))
    joined = judged.join(spread, judged["key"] == spread["node"], "left")
    return joined.select("page_id", "host", "path", "own.rule", F.coalesce("own.verdict", "spread", F.lit(default)).alias("verdict"))
