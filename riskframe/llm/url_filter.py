"""URL filters: block decisions spread over redirect-equivalent addresses.

Native DataFrame functions only. A page's own rule (longest fit) decides first.
Pages without a rule take the decision of their component over redirect and
canonical-link edges: an explicit allow in it wins over a block, and a component
without any rule is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise

#: (verdict, host, path): the rule list, in its text form ``host`` + ``path``.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_REST = r"(?s)^.*?://(.*)$"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
_REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_CONTENT_URL = r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)"


def _after_scheme(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _REST, 1), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. A rule fits
    its host and all subdomains if the path starts with the rule's."""
    by_length = sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in by_length]
    return F.coalesce(*fits)


def canonical_key(url: Column) -> Column:
    """The address that the usual permanent redirects lead to: without scheme,
    default port, ``www.`` or ``m.``, fragment, index page, tracking parameters
    and a slash at the end."""
    rest = F.regexp_replace(_after_scheme(url), r"(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER),
                                             r":(?:80|443)$", ""), r"^(?:www|m)\.", "")
    tail = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1), r"(?<=[?&])(?:utm_[a-z]+|gclid|fbclid|ref)=[^&]*&?", "")
    tail = F.regexp_replace(F.regexp_replace(tail, r"[?&]+$", ""), r"/(?:index\.html?)?(?=\?|$)", "")
    return F.when(url.contains("://"), F.concat(host, tail))


def declared_targets(url: Column, html: Column) -> Column:
    """Where the page says it lives: the addresses of all its canonical links and
    refresh redirects, resolved against url."""
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)

    def resolved(link: Column) -> Column:
        return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, link))
                .when(link.startswith("/"), F.concat(origin, link))
                .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link)))

    def links(tags: Column, kind: str, place: str) -> Column:
        own = F.transform(F.filter(tags, lambda t: t.rlike(kind)), lambda t: F.regexp_extract(t, place, 1))
        return F.transform(F.filter(own, lambda x: x != ""), resolved)

    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_TAG), F.lit(0))
    return F.array_distinct(F.concat(links(tags, _CANONICAL, _HREF), links(tags, _REFRESH, _CONTENT_URL)))


def _node(key: Column) -> Column:
    """128-bit name of an address: components run over names, not over strings."""
    return F.md5(key)


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, rule_verdict, component for every row of
    pages (page_id, url, html); redirects (from_url, to_url) adds logged edges.

    Edges go to every canonical link and refresh redirect of a page; the rules of
    both ends of an edge count, whether they are rows of pages or not.

    A null url or one without ``://`` has an empty host and path, fits no rule,
    belongs to no component and is allowed. Repeated rows are judged alike.
    """
    url = F.col("url").cast("string")
    named = lambda u: _node(canonical_key(u))
    fit = lambda u: fitting_rule(host_of(F.coalesce(u, F.lit(""))), path_of(F.coalesce(u, F.lit(""))), rules)
    cut = pages.select("page_id", host_of(F.coalesce(url, F.lit(""))).alias("host"),
                       path_of(F.coalesce(url, F.lit(""))).alias("path"), canonical_key(url).alias("key"))
    judged = (cut.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
              .select("page_id", "host", "path", "fit.rule", F.col("fit.verdict").alias("rule_verdict"), _node(F.col("key")).alias("node")))
    # both ends of every edge with their own rules: a target need not be a row of pages
    pairs = pages.select(url.alias("a"), F.explode(declared_targets(url, F.col("html").cast("string"))).alias("b"))
    if redirects is not None:
        pairs = pairs.union(redirects.select(F.col("from_url").cast("string"), F.col("to_url").cast("string")))
    links = materialise(pairs.select(named(F.col("a")).alias("u"), named(F.col("b")).alias("v"), fit(F.col("a"))["verdict"].alias("u_verdict"),
                                     fit(F.col("b"))["verdict"].alias("v_verdict")).distinct(), "links")
    edges = links.where("u <> v").select("u", "v")
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("u_verdict").alias("rule_verdict")),
                                          F.struct(F.col("v").alias("node"), F.col("v_verdict").alias("rule_verdict")))).alias("e")).select("e.*")
    components = connected_components(edges.distinct())
    # pages of one key are one node: decide per node first, then per component
    has = lambda what: F.max(F.coalesce(F.col("rule_verdict") == what, F.lit(False)))
    nodes = (judged.select("node", "rule_verdict").union(ends).where("node IS NOT NULL").groupBy("node").agg(has("allow").alias("allow"), has("block").alias("block"))
             .join(components, "node", "left").withColumn("component", F.coalesce("component", "node")))
    whole = nodes.groupBy("component").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    spread = nodes.select("node", "component").join(whole, "component")
    spread = spread.select("node", "component", F.when(F.col("block") & ~F.col("allow"), "block").otherwise("allow").alias("spread"))
    return (judged.join(spread, "node", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "spread", F.lit("allow")).alias("verdict"),
                    "rule_verdict", "component"))
