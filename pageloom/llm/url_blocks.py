"""URL filters: rules on hosts and paths, carried over to aliases.

Two addresses are aliases if a redirect or a canonical link leads from one to the
other, at any number of steps. A rule's decision holds for its own addresses; an
address without a rule takes the decision of its aliases, where an explicit allow
comes before any block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.core import lit
from pageloom.functions.urls import canonical_url, resolve_url
from pageloom.llm.graph import components
from pageloom.llm.tables import plain_columns, stored

#: (host, path the url's path starts with, verdict)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

_AFTER = "substr(url, instr(url, '://') + 3)"
HOST = (
    "IF(coalesce(instr(url, '://'), 0) = 0, '', translate(regexp_extract("
    f"{_AFTER}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
)
PATH = f"IF(coalesce(instr(url, '://'), 0) = 0, '', regexp_extract({_AFTER}, '^[^/?#]*([^?#]*)', 1))"

# comments and scripts are stepped over whole, to the end where they aren't closed
_TAGS = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)|<(?:link|meta)\b[^>]*+>"


def _attr(name: str) -> str:
    """SQL: the value of an attribute of ``tag``, or the empty text."""
    pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return "concat(" + ", ".join(f"regexp_extract(tag, {lit(pattern)}, {k})" for k in (1, 2, 3)) + ")"


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target): canonical links and refresh redirects in the pages' HTML, resolved.

    Only pages that name one of them at all are taken apart, up to their last ``>``: a tag that
    starts behind it has no end, and looking for one again and again takes the square of
    the page's length."""
    named = plain_columns(pages, "url", "html").where("html RLIKE '(?i)canonical|refresh'")
    closed = "left(html, length(html) - length(substring_index(html, '>', -1)))"
    tags = named.select("url", F.explode(F.expr(f"regexp_extract_all({closed}, {lit(_TAGS)}, 0)")).alias("tag"))
    canonical = f"IF(lower(tag) LIKE '<link%' AND {_attr('rel')} RLIKE '(?i)(^|\\\\s)canonical(\\\\s|$)', {_attr('href')}, '')"
    refresh = (
        f"IF(lower(tag) LIKE '<meta%' AND lower({_attr('http-equiv')}) = 'refresh',"
        f" regexp_extract({_attr('content')}, {lit(r'(?i)url\s*=\s*[\x22\x27]?([^\x22\x27]*)')}, 1), '')"
    )
    refs = tags.select("url", F.expr(f"trim(concat({canonical}, {refresh}))").alias("ref")).where("ref <> ''")
    return refs.select(F.col("url").alias("source"), resolve_url("url", "ref").alias("target"))


def _rules(spark: SparkSession, rules) -> DataFrame:
    rows = [(h, p, v, h + p) for h, p, v in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule_verdict string, rule string")


def _host_rules(hosts: DataFrame, rules) -> DataFrame:
    """(host, choices): the rules on a host or a domain above it, longest first.

    Hosts are made distinct first, so a host with a third of all pages is one row.
    A host's choices are no more than the rules that name it."""
    above = "transform(sequence(1, size(split(host, '[.]'))), k -> substring_index(host, '.', -k))"
    named = hosts.distinct().select("host", F.explode(F.expr(above)).alias("rule_host"))
    choice = F.struct(
        (-F.length("rule")).alias("order"), F.col("rule_path").alias("path"),
        F.col("rule_verdict").alias("verdict"), "rule",
    )
    return (
        named.join(_rules(hosts.sparkSession, rules), "rule_host")
        .groupBy("host")
        .agg(F.sort_array(F.collect_set(choice)).alias("choices"))
    )


def _ruled(urls: DataFrame, rules) -> DataFrame:
    """Adds host, path, rule and own (the rule's verdict) to rows with a ``url``."""
    parts = urls.withColumns({"host": F.expr(HOST), "path": F.expr(PATH)})
    with_choices = parts.join(_host_rules(parts.select("host"), rules), "host", "left")
    first = "get(filter(choices, c -> startswith(path, c.path)), 0)"
    return (
        with_choices.withColumn("chosen", F.expr(first))
        .withColumns({"rule": F.col("chosen.rule"), "own": F.col("chosen.verdict")})
        .drop("choices", "chosen")
    )


def alias_verdicts(links: DataFrame, rules=RULES) -> DataFrame:
    """(node, verdict) of every address with an alias: allow if any address of its
    class has an allow rule, else block if any has a block rule, else null."""
    ends = links.select(canonical_url("source").alias("a"), canonical_url("target").alias("b"))
    classes = stored(components(stored(ends.where("a <> b")), "a", "b"))
    judged = _ruled(classes.select("component", F.col("node").alias("url")), rules)
    verdicts = judged.groupBy("component").agg(
        F.expr("CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' END").alias("verdict")
    )
    return classes.join(verdicts.where("verdict IS NOT NULL"), "component").select("node", "verdict")


def judged(pages: DataFrame, links: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and alias_verdict of every row of ``pages``.

    ``links`` (source, target) are redirects known from elsewhere; the pages' own
    canonical links and refreshes count besides. Null or odd addresses have empty
    host and path, no rule, and are allowed. Repeated rows stay repeated; an empty
    table gives no rows. Only page_id and url of a page travel, not its HTML."""
    found = page_links(pages)
    if links is not None:
        found = found.unionByName(links.select("source", "target"))
    aliases = alias_verdicts(found, rules).withColumnRenamed("verdict", "alias_verdict")
    rows = _ruled(plain_columns(pages, "page_id", "url"), rules).withColumn("node", canonical_url("url"))
    return rows.join(aliases, "node", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", "alias_verdict", F.lit("allow")).alias("verdict"), "alias_verdict",
    )
