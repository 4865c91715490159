"""URL filters with redirect equivalence.

Rules decide the urls they fit. Aliases share a fate beyond that: redirects, canonical links and canonical spellings
are edges, their connected components are found on the cluster, and a block spreads over its component unless an
explicit allow lies in it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.components import components
from bazaarlens.session import cut_lineage

#: Query parameters that do not change what a page shows.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|session(?:id)?)=[^&]*"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
         Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; of equal length an allow comes first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow", r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(url: Column) -> Column:
    """One spelling for a page: no scheme, `www.` or `m.` before the host, fragment, tracking parameters, `.html`,
    `index` or closing slash. Null without `://`."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m|amp)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/index)?(?:\.html?)?/*$", "")
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), f"(?i)(?<![^&]){TRACKING}(?:&|$)", "")
    query = F.regexp_replace(query, "&$", "")
    whole = F.concat(F.lit("//"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole)


def resolved(url: Column, target: Column) -> Column:
    """A link target as a whole url, completed from the page's own; null if that has no `://` to complete from, or if
    the target has a scheme without `://`."""
    head, tail = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    own = path_of(url)
    folder = F.concat(F.regexp_replace(own, r"[^/]*$", ""), F.when(own.startswith("/"), "").otherwise("/"))
    path = F.when(head == "", own).when(head.startswith("/"), head).otherwise(F.concat(folder, head))
    steps = F.split(F.regexp_replace(path, r"(?<=/)(\.\.?)$", "$1/"), "/")
    steps = F.aggregate(steps, F.array().cast("array<string>"), lambda have, x: F.when(x == ".", have).when(
        x == "..", F.slice(have, 1, F.greatest(F.size(have) - 1, F.least(F.size(have), F.lit(1)))))
        .otherwise(F.array_append(have, x)))  # the first step is the empty one before the first slash
    scheme = F.regexp_extract(url, "(?s)^(.*?)://", 1)
    whole = F.concat(scheme, F.lit("://"), host_of(url), F.array_join(steps, "/"), tail)
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(F.instr(target, "://") > 0, target))
            .when(F.instr(url, "://") == 0, None).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("#"), F.concat(F.regexp_extract(url, "(?s)^[^#]*", 0), target)).otherwise(whole))


def declared(url: Column, html: Column) -> Column:
    """Urls that a page names as itself: all its canonical links and refresh redirects, relative ones completed from the
    page's own url."""
    attr = r"""[^>]*\b{}\s*=\s*["']?[^"'>]*{}"""
    rel, href = r"""\brel\s*=\s*["']?canonical\b""", r"""\bhref\s*=\s*["']?([^"'\s>]+)"""
    patterns = (rf"(?is)<link\b[^>]*{rel}[^>]*{href}", rf"(?is)<link\b[^>]*{href}[^>]*{rel}",
                rf"""(?is)<meta{attr.format('http-equiv', 'refresh')}[^>]*url=\s*["']?([^"'\s>;]+)""")
    links = F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in patterns])
    return F.array_distinct(F.array_compact(F.transform(links, lambda x: resolved(url, x))))


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(url, alias) from pages (url, html) and, if there is one, a table of redirects (url, target)."""
    own = pages.where("url is not null").select("url", declared(F.col("url"), F.col("html")).alias("links"))
    edges = own.select("url", F.explode("links").alias("alias"))
    if redirects is not None:
        edges = edges.union(redirects.select("url", F.col("target").alias("alias")).dropna())
    named = own.select("url").union(edges.select("alias")).distinct()
    return edges.union(named.select("url", canonical(F.col("url")).alias("alias")).dropna())


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url, html; others are not read).

    A url that a rule fits has the rule's verdict. Any other is blocked if a rule blocks one of its aliases (pages,
    redirect and link targets) and none allows one; else allowed. A null url, or one without `://`, has an empty
    host and path, no alias and is allowed. Repeated rows, ties and repeated edges change nothing."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = cut_lineage(alias_edges(rows, redirects).select(
        F.xxhash64("url").alias("a"), F.xxhash64("alias").alias("b"), "url", "alias").distinct())
    nodes = edges.select(F.col("a").alias("node"), "url").union(
        edges.where(~F.col("alias").startswith("//")).select("b", "alias")).distinct()
    verdict = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"]
    found = components(edges.select("a", "b"))
    fate = (nodes.withColumn("verdict", verdict).join(found, "node")
            .groupBy("component").agg(F.bool_or(F.col("verdict") == "block").alias("blocked"),
                                      F.bool_or(F.col("verdict") == "allow").alias("allowed")))
    spread = fate.where("blocked and not coalesce(allowed, false)").select("component")
    hit = found.join(spread, "component", "left_semi").select("node")
    own = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("node", F.xxhash64("url"))
    out = own.join(hit.withColumn("spread", F.lit(True)), "node", "left")
    by_alias = F.when(F.col("spread"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                      F.coalesce("fit.verdict", by_alias).alias("verdict"))
