"""URL filters: longest rule by host and path, carried over redirect and canonical links to aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components

#: Fixed values of the production query: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """From the first ``?`` after the host up to ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` segments worked off."""
    none = F.array().cast("array<string>")
    parts = F.split(path, "/")
    parts = F.slice(parts, F.lit(2), F.size(parts))
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    left = F.aggregate(parts, none, lambda a, x: F.when(x == ".", a).when(x == "..", up(a)).otherwise(F.concat(a, F.array(x))))
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(F.concat(left, end), "/"))).otherwise(path)


def node_of(host: Column, path: Column, query: Column) -> Column:
    """The whole url without scheme and fragment; no path is the root."""
    return F.concat(host, F.when((host != "") & (path == ""), "/").otherwise(without_dots(path)), query)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src_host, src_path, src_query, dst_host, dst_path, dst_query) from canonical links and refresh redirects in the pages.

    Targets are resolved against the page's url: absolute, without a scheme (``//host/path``), from the root (``/path``),
    from the page's folder (``page.html``, ``../x``) and queries (``?p=1``). Other schemes and bare fragments link nothing.
    """
    tag = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>|<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
    p = pages.select(F.col(url).alias("u"), F.col(html).alias("h")).where(F.col("h").rlike("(?i)canonical|http-equiv"))
    p = p.select("u", F.explode(F.regexp_extract_all("h", F.lit(tag), 0)).alias("t"))
    to = F.regexp_extract("t", r"(?is)(?:\bhref\s*=\s*[\"']?|\burl\s*=\s*['\"]?)([^\"'\s>]+)", 1)
    p = p.select("u", F.regexp_replace(to, "(?i)&amp;|&#38;|&#x26;", "&").alias("to")).where("to <> ''")
    u, to = F.col("u"), F.col("to")
    root = F.concat(F.lit("http://"), host_of(u))
    folder = F.coalesce(F.regexp_extract(path_of(u), r"(?s)\A(.*/)", 1), F.lit(""))
    full = F.when(to.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(F.lit("http:"), to))
    full = full.when(to.startswith("/"), F.concat(root, to)).when(to.startswith("?"), F.concat(root, path_of(u), to))
    full = full.when(to.startswith("#") | to.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
    full = full.otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), to))
    p = p.select("u", full.alias("to")).where("to is not null")
    src = [host_of(u).alias("src_host"), path_of(u).alias("src_path"), query_of(u).alias("src_query")]
    return p.select(*src, host_of(to).alias("dst_host"), without_dots(path_of(to)).alias("dst_path"), query_of(to).alias("dst_query")).where("src_host <> '' and dst_host <> ''")


def rule_for(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path) with rule and verdict of the longest rule that fits; null where none does.

    Rules (verdict, host, path) meet urls by equality on each suffix of the host, so neither side is
    broadcast unless Spark knows it to be small. Equal lengths: allow before block, then by text.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    u = urls.select("host", "path").distinct()
    r = rules.select(F.col("verdict").alias("rule_verdict"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    hit = u.withColumn("suffix", F.explode(F.array_distinct(suffixes))).join(r, F.col("suffix") == F.col("rule_host"))
    hit = hit.where("startswith(path, rule_path)")
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("rule_verdict") == "allow").alias("a"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("b")
    return u.join(hit.groupBy("host", "path").agg(best).select("host", "path", "b.rule", "b.verdict"), ["host", "path"], "left")


def filter_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for each row of ``pages``.

    Urls that redirect or canonical links join are aliases of one page. A url's own rule decides it; a url
    without one takes allow if an alias has an allow rule, else block if an alias has a block rule, else allow.
    Aliases are whole urls with their query strings; rules read host and path alone. component is the smallest
    ``host`` + ``path`` + ``query`` of its aliases. Null urls and urls without ``://`` have empty host and path,
    no rule and verdict allow; repeated rows give repeated results.
    """
    edges = link_edges(pages, url, html) if edges is None else edges
    whole = ["host", "path", "query"]
    end = lambda at: edges.select(*[F.col(f"{at}_{c}").alias(c) for c in whole])
    key = lambda *at: node_of(*[F.col(c) for c in at])
    p = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), query_of(F.col(url)).alias("query"))
    urls = p.select(*whole).unionByName(end("src")).unionByName(end("dst")).distinct()
    judged = urls.join(rule_for(urls, rules), ["host", "path"])
    groups = connected_components(edges.select(key("src_host", "src_path", "src_query").alias("src"), key("dst_host", "dst_path", "dst_query").alias("dst")))
    # an url without links is a component of its own: no key that all of them share
    judged = judged.withColumn("node", key(*whole)).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_group = judged.join(groups.select("component").distinct(), "component", "left_semi").where("verdict is not null")
    of_group = of_group.groupBy("component").agg(F.min("verdict").alias("spread"))  # allow sorts before block
    judged = judged.join(of_group, "component", "left")
    judged = judged.select(*whole, "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict"), "component")
    out = p.where("host <> '' or path <> ''").join(judged, whole).select("page_id", "host", "path", "rule", "verdict", "component")
    none = p.where("host = '' and path = ''")  # nothing judges these, so they need not meet
    return out.unionByName(none.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit("").alias("component")))
