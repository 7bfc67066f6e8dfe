"""URL filters with redirect equivalence.

Rules allow or block a host (with its subdomains) and a path prefix; the
longest that fits a URL decides. URLs that no rule fits take the decision of
their aliases: redirects (``meta refresh``) and canonical links found in the
pages make URLs equivalent, components of those edges are the alias classes,
and a class that holds a blocked URL is blocked, unless it also holds an
explicitly allowed one (allow has precedence). URLs outside the table that
are only linked to take part as members. A page may hold several such tags, and
relative targets are resolved against the page's URL. Everything else is allowed.

DataFrame functions only; the rules are a list of the caller and become one
literal array.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits
no rule, has no aliases and is allowed; null html has no edges; rules of equal
length: allow wins; repeated pages get repeated rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), *LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """Host, path and query: what names a page. Null without a host."""
    query = F.regexp_extract(url, r"(?s)\A.*?://[^?#]*(\?[^#]*)?", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), F.coalesce(query, F.lit(""))))


def decision(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest (verdict, host, path) rule that fits, else null."""
    if not rules:
        return F.lit(None).cast("struct<length:int,allow:boolean,rule:string>")
    table = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"),
                               F.struct(F.lit(len(h + p)).alias("length"), F.lit(v == "allow").alias("allow"),
                                        F.lit(h + p).alias("rule")).alias("what")) for v, h, p in rules])
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"])))
                    & F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: r["what"]))


def without_dots(path: Column) -> Column:
    """An absolute path (from ``/``) with its ``.`` and ``..`` segments carried out."""
    steps = F.slice(F.split(path, "/", -1), 2, F.greatest(F.size(F.split(path, "/", -1)) - 1, F.lit(0)))
    dots = lambda s: s.isin(".", "..")
    done = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda out, s: F.when(s == ".", out).when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))))
        .otherwise(F.concat(out, F.array(s))))
    end = F.when(dots(F.element_at(steps, -1)) & (F.size(done) > 0), "/").otherwise("")  # a last dot segment names a folder
    return F.when(F.size(steps) > 0, F.concat(F.lit("/"), F.array_join(done, "/"), end)).otherwise(path)


def resolved(to: Column, url: Column) -> Column:
    """The absolute URL that reference ``to`` names on the page at ``url`` (RFC 3986, 5.2); null
    where ``to`` has a scheme that names no page (``mailto:``) or ``url`` has no ``://``."""
    scheme = F.regexp_extract(url, r"(?s)\A(.*?:)//", 1)
    root = F.regexp_extract(url, r"(?s)\A(.*?://[^/?#]*)", 1)
    path = path_of(url)
    query = F.regexp_extract(url, r"(?s)\A.*?://[^?#]*(\?[^#]*)?", 1)
    own = F.regexp_extract(to, r"(?s)\A([^?#]*)", 1)  # the reference's path
    rest = F.regexp_extract(to, r"(?s)\A[^?#]*(.*)\z", 1)
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), r"(?s)\A(.*/)", 1)
    full = (F.when(F.rlike(to, F.lit(r"\A[A-Za-z][A-Za-z0-9+.-]*://")), to)
            .when(F.startswith(to, F.lit("//")), F.concat(scheme, to))
            .when(F.rlike(to, F.lit(r"\A[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None).cast("string"))
            .when(F.startswith(to, F.lit("/")), F.concat(root, without_dots(own), rest))
            .when(F.startswith(to, F.lit("?")), F.concat(root, path, to))
            .when((to == "") | F.startswith(to, F.lit("#")), F.concat(root, path, query, to))
            .otherwise(F.concat(root, without_dots(F.concat(folder, own)), rest)))
    return F.when(root != "", full)


def alias_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a, b) addresses joined by a canonical link or a redirect of page a; every such tag counts,
    and relative targets are resolved against the page's URL."""
    html, name = F.col(html_col), F.col("tag")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link\b[^>]*\brel\s*=\s*[\"']?canonical"
                                            r"|meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh)\b[^>]*>)"), F.lit(1))
    href = F.regexp_extract(name, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    goes = F.regexp_extract(name, r"(?is)\burl\s*=\s*['\"]?([^\"'\s>;]+)", 1)
    both = pages.filter(F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("refresh"))) \
        .select(F.col(url_col).alias("url"), F.explode(tags).alias("tag")) \
        .select("url", F.when(F.rlike(name, F.lit(r"(?i)\A<link")), href).otherwise(goes).alias("to")).filter("to <> ''")
    full = resolved(F.replace("to", F.lit("&amp;"), F.lit("&")), F.col("url"))
    return both.select(address(F.col("url")).alias("a"), address(full).alias("b")).filter("a is not null and b is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and inherited (the verdict came from an alias)."""
    classes = components(alias_edges(pages, url_col, html_col))
    # an address has no scheme, so host and path are read off behind an empty one
    node = F.concat(F.lit("://"), F.col("node"))
    ruled = classes.withColumn("d", decision(rules, host_of(node), path_of(node))).filter("d is not null")
    verdicts = ruled.groupBy("component").agg(F.max("d.allow").alias("class_allows"))
    known = classes.join(verdicts, "component").select(F.col("node").alias("address"), "class_allows")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"), address(F.col(url_col)).alias("address"))
    rows = rows.withColumn("d", decision(rules, F.col("host"), F.col("path"))).join(known, "address", "left")
    allow = F.coalesce("d.allow", "class_allows", F.lit(True))
    return rows.select("page_id", "host", "path", F.col("d.rule").alias("rule"),
                       F.when(allow, "allow").otherwise("block").alias("verdict"),
                       (F.col("d").isNull() & F.col("class_allows").isNotNull()).alias("inherited"))
