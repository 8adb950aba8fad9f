"""URL filtering with pattern rules that are indexed by their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import Scratch

#: Beyond so many rules the index is not broadcast but joined by a shuffle.
MAX_BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against host + path; ``tokens`` are literals that any match holds whole (none given: see ``literals``)."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] | None
    rank: int


def literals(pattern: str) -> tuple[str, ...]:
    """Tokens that each match of a pattern holds whole, as far as that is plain from it.

    Runs of letters a-z and digits count where a literal mark, or an anchored start or end, stands on both sides.  What may
    be missing, and all inside groups, classes and alternatives, says nothing.
    """
    out: list[str] = []
    word, closed, at = "", False, 0  # whether the run began behind a mark

    def end(by_mark: bool) -> None:
        nonlocal word, closed
        if word and closed and by_mark:
            out.append(word)
        word, closed = "", by_mark

    pattern = re.sub(r"^\(\?[a-z]+\)", "", pattern)
    while at < len(pattern):
        c, size = pattern[at], 1
        if c == "\\":
            size = 2
            c = pattern[at + 1 : at + 2]
            mark = not c.isalnum()
            literal = None
        elif c == "[":
            size = re.match(r"\[\^?\]?(?:\\.|[^\]\\])*\]?", pattern[at:]).end()
            mark, literal = False, None
        elif c in "(":
            depth, size = 1, 1
            while depth and at + size < len(pattern):
                step = pattern[at + size]
                if step == "[":
                    size += re.match(r"\[\^?\]?(?:\\.|[^\]\\])*\]?", pattern[at + size :]).end()
                    continue
                depth += (step == "(") - (step == ")")
                size += 2 if step == "\\" else 1
            mark, literal = False, None
        elif c == "|":
            return ()
        else:
            literal = c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else None
            mark = literal is None and c not in ".)ABCDEFGHIJKLMNOPQRSTUVWXYZ" and ord(c) < 128
        more = re.match(r"[*+?]+|\{[0-9,]*\}[?+]?", pattern[at + size :])
        if more:
            # A repeated part neither belongs to a whole token nor bounds one for certain.
            end(False)
            at += size + more.end()
            continue
        if literal:
            word += literal
        else:
            end(mark)
        at += size
    return tuple(dict.fromkeys(out))


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains and all paths that start with ``path``; longer ones win."""
    open_end = re.sub(r"[^a-z0-9]", " ", path.lower()).split(" ")[:-1]
    tokens = [t for t in re.split(r"[^a-z0-9]+", host) + open_end if t]
    pattern = rf"(?s)^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}.*"
    return Rule(host + path, verdict, pattern, tuple(tokens), 1_000_000 + len(host + path))


def host_words(verdict: str, *words: str) -> Rule:
    """A weaker rule: the host holds these words in this order, joined by a hyphen."""
    pattern = rf"(?s)^(?:[^/]*[^a-z0-9/])?{'-'.join(map(re.escape, words))}(?:[^a-z0-9].*)?$"
    return Rule("-".join(words), verdict, pattern, words, len("-".join(words)))


#: The fixed rules of the query's contract.
CONTRACT_RULES = (
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
)
#: What the method adds where no such rule fits: hosts named for spam.
SPAM_RULES = tuple(
    host_words("block", *name.split("-"))
    for name in ("spam-farm", "cheap-pills", "free-casino", "casino-bonus", "adult-cams", "payday-loans", "link-farm")
)


def host(url: Column) -> Column:
    return ascii_host(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def ascii_host(name: Column) -> Column:
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (name of the rule that decides) and ``verdict``.

    ``rules`` are ``Rule`` objects, or a table with their columns ``name``, ``verdict``, ``pattern`` and ``rank``,
    whose tokens are taken from the patterns.

    The pages' URLs are cut into tokens; the tokens that rules name are counted over all URLs, and every
    rule is filed under its rarest one.  A URL fetches the rules filed under its tokens and runs the
    regular expressions of those alone.  The rule of highest rank decides, then block before allow,
    then the name; without any the verdict is ``default``.

    Null urls and such without ``://`` have an empty host and path and fit no rule; repeated rows each
    keep a row.  Rules without tokens run on every URL.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        found = F.udf(lambda p: list(literals(p or "")), "array<string>")  # of rules, which are few beside the pages
        known = rules.where("pattern is not null").select(F.xxhash64("name", "pattern", "verdict").alias("rule_no"), "name", "verdict", "pattern", found("pattern").alias("tokens"), F.col("rank").cast("int").alias("rank")).dropDuplicates(["rule_no"])
        known = Scratch(spark).write(known)
        few = known.count() <= MAX_BROADCAST_RULES
    else:
        table = [(k, r.name, r.verdict, r.pattern, list(literals(r.pattern) if r.tokens is None else r.tokens), r.rank) for k, r in enumerate(rules)]
        known = spark.createDataFrame(table, "rule_no long, name string, verdict string, pattern string, tokens array<string>, rank int")
        few = len(rules) <= MAX_BROADCAST_RULES
    row = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    row = row.withColumn("row", F.monotonically_increasing_id())
    tokens = F.array_distinct(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"))
    named = known.select("rule_no", F.explode("tokens").alias("token"))
    wanted = named.select("token").distinct()
    hint = F.broadcast if few else (lambda df: df)
    counts = row.select(F.explode(tokens).alias("token")).join(hint(wanted), "token").groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    rarest = (
        named.join(counts, "token", "left").groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token"))["token"].alias("token"))
    )
    filed = known.join(rarest, "rule_no", "left").select("rule_no", "name", "verdict", "pattern", "rank", F.coalesce("token", F.lit("")).alias("token"))
    url = row.select("*", F.explode(F.array_union(tokens, F.array(F.lit("")))).alias("token"), F.lit("").alias("first"))
    # The empty token stands for every URL once: it carries the row itself and meets the rules without tokens.
    tried = url.join(hint(filed), "token", "left")
    fits = F.col("pattern").isNotNull() & F.expr("rlike(concat(host, path), pattern)") & (F.col("host") != "")
    best = F.struct("rank", (F.col("verdict") == "block").alias("blocks"), "name", "verdict")
    tried = tried.where((F.col("token") == "") | F.col("pattern").isNotNull()).select("row", "id", "host", "path", F.when(fits, best).alias("fit"))
    found = tried.groupBy("row").agg(*(F.first(c).alias(c) for c in ("id", "host", "path")), F.max("fit").alias("fit"))
    return found.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.name").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict")
    )
