"""URL filters: host-suffix and path-prefix expressions looked up by short hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.store import ascii_lower


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules`` has ``action`` (allow or block) and ``rule`` (a host, then a path that starts
    with a slash). A rule fits its host and subdomains where the path starts with its path.
    The longest fitting rule wins, then the one with the longer host, then block.

    Distinct (host, path) pairs are expanded only to the numbers of labels and the path
    lengths that occur in the rules (two sets of small whole numbers, all the driver sees),
    joined to the rules on the first four bytes of a digest, and confirmed by all of it.
    Popular URLs shrink to one row before the shuffle. Spark broadcasts the rules when they
    are small and shuffles both sides otherwise.
    A URL that is null or has no ``://`` has empty host and path, fits no rule, and gets the
    default; so does everything where there are no rules. Null rules are ignored and
    repeated rules count once. Repeated rows are judged alike; other columns are ignored.
    """
    cut = F.instr("rule", "/")
    known = rules.where("rule is not null and action is not null and instr(rule, '/') > 0").select("action", "rule", ascii_lower(F.col("rule").substr(F.lit(1), cut - 1)).alias("rh"), F.substring("rule", cut, F.length("rule")).alias("rp")).distinct()
    dots = F.length("rh") - F.length(F.replace("rh", F.lit("."), F.lit(""))) + 1
    shapes = known.select(dots.alias("labels"), F.length("rp").alias("chars")).distinct()
    labels = sorted(r[0] for r in shapes.select("labels").distinct().collect())
    chars = sorted(r[0] for r in shapes.select("chars").distinct().collect())

    host, path = url_parts(F.col(url_col).cast("string"))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not labels:
        return own.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    n = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    suffixes = F.array_compact(F.array(*(F.when(n >= k, F.substring_index("host", ".", -k)) for k in labels)))
    prefixes = F.array_compact(F.array(*(F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in chars)))
    asked = own.where("host <> ''").select("host", "path").distinct()
    asked = asked.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    asked = asked.select("host", "path", _digest(F.concat("suffix", "prefix")).alias("digest")).withColumn("key", F.substring("digest", 1, 8))
    index = known.select("action", "rule", F.length("rh").alias("nh"), _digest(F.concat("rh", "rp")).alias("full")).withColumn("key", F.substring("full", 1, 8))
    fits = asked.join(index, "key").where("digest = full")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "nh", F.col("action") == "block", "rule", "action")).alias("best"))
    return own.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
