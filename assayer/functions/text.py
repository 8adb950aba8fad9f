"""Text and code functions as column expressions; ASCII word semantics throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns.
CODE_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[^\sA-Za-z_]"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
SHINGLE_TOKEN = r"[A-Za-z_][A-Za-z_0-9]*|[0-9]+|\S"
# Phrases that say what was amiss, trailers of commit messages, and lines of differences.
REMEDY = (
    r"(?i)\b(missing|lack(s|ing)? of|lacks|without (a |any |proper(ly)? )?(check|valid|verif|bound|sanit|limit)|"
    r"does not (properly |correctly |always )?(check|validat|verif|ensure|handle|sanitiz|limit|bound|free|release|"
    r"initializ|restrict|reject|account|consider|enforce|clear|reset|lock|prevent|confirm|compare|detect|test)|"
    r"doesn'?t (check|validat|verif|ensure|handle)|fail(s|ed|ing)? to|improper(ly)?|insufficient(ly)?|"
    r"incorrect(ly)? (check|validat|verif|handl|comput|calculat|bound|limit|compar|account)|"
    r"unchecked|unvalidated|unverified|unbounded|unsanitized|uninitiali[sz]ed|not (properly |correctly )?"
    r"(checked|validated|verified|bounded|sanitized|initialized|handled|released|freed)|should (be |have )?|must (be )?|"
    r"off[- ]by[- ]one|wrong (check|comparison|bound|length|size|sign|type|order)|"
    r"mishandl|miscalculat|miscomput|forget(s)? to|neglect(s)? to|omit(s|ted)? )"
)
TRAILER = (
    r"(?i)^((signed-off-by|reviewed-by|reviewed-on|tested-by|acked-by|cc|change-id|bug|fixes|link|"
    r"reported-by|suggested-by|co-authored-by|closes|resolves|see-also|commit-queue|cr-commit-position|"
    r"review url|bug-?id|tbr|r|notry|notreechecks|cq-include-trybots)\s*[:=]|"
    r"(merged|merge) (from|revision|r\d)|\(cherry picked|\[\d+\.\d+(\.\d+)?\]\s*$)"
)
REFERENCE = r"^[A-Za-z-]+:\s*(https?://|\S+@\S+)"
DIFF_LINE = r"^(\+|-|@@|```|diff |index |--- |\+\+\+ )|[;{}]$"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def code_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CODE_TOKEN), F.lit(0))


def identifiers(text: Column, least: int = 1) -> Column:
    """Different identifiers of at least so many characters, in order of first use."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)))
    return found if least == 1 else F.filter(found, lambda t: F.length(t) >= least)


def windows(items: Column, k: int, joined) -> Column:
    """``joined`` of every ``k`` neighbours (null beyond the end), of all where there are fewer; none of none.

    Neighbours are read by their place: a slice would copy the whole array for each window.
    """
    last = F.greatest(F.size(items) - k, F.lit(0))
    every = F.transform(F.sequence(F.lit(0), last), lambda i: joined(*(F.get(items, i + j) for j in range(k))))
    return F.when(F.size(items) > 0, every)


def shingles(text: Column, k: int = 5) -> Column:
    """Different runs of ``k`` tokens, joined by a blank; a shorter text that has tokens is one shingle."""
    tokens = F.regexp_extract_all(text, F.lit(SHINGLE_TOKEN), F.lit(0))
    found = let(tokens, lambda t: windows(t, k, lambda *w: F.concat_ws(" ", *w)))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def shingle_keys(text: Column, k: int = 5) -> Column:
    """64-bit hashes of the different shingles."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(SHINGLE_TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    found = let(tokens, lambda t: windows(t, k, F.xxhash64))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<bigint>"))


def char_grams(text: Column, k: int = 4) -> Column:
    """Different runs of ``k`` characters after blanks are removed; none for a shorter text."""
    chars = F.filter(F.split(F.regexp_replace(text, r"\s+", ""), ""), lambda c: c != "")
    found = let(chars, lambda c: F.when(F.size(c) >= k, windows(c, k, F.concat)))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def canonical_code(text: Column) -> Column:
    """Without block and line comments, with single blanks."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    return strip(F.regexp_replace(bare, r"\s+", " "))


def abstract_code(text: Column) -> Column:
    """Every identifier is X and every number 0, without blanks: equal for renamed copies."""
    named = F.regexp_replace(text, IDENTIFIER, "X")
    return F.regexp_replace(F.regexp_replace(named, "[0-9]+", "0"), r"\s+", "")


def lines(text: Column) -> Column:
    """Lines without the empty one that a final line feed leaves."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def statements(text: Column) -> Column:
    """Lines with blanks removed, without those that are empty or only braces."""
    bare = F.transform(lines(canonical_lines(text)), lambda s: F.regexp_replace(s, r"\s+", ""))
    return F.filter(bare, lambda s: ~s.rlike(r"^[{}]*$"))


def canonical_lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")


def class_id(text: Column) -> Column:
    """The number of a weakness class in one spelling, or CWE-unknown."""
    number = F.regexp_extract(text, r"(?i)CWE[-_ ]?([0-9]+)", 1)
    return F.when(number != "", F.concat(F.lit("CWE-"), number)).otherwise("CWE-unknown")


def edit_skeleton(text: Column) -> Column:
    return F.regexp_replace(text, r"[0-9\s+*/<>=!&|-]+", "")


def line_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty texts."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def clean_message(text: Column, added: Column, most: int = 1500) -> Column:
    """Struct of a ``cleaned`` message, how many lines were removed as ``code``, ``leak`` and ``trailer``, and ``truncated``.

    Trailers, lines of differences or code, and lines of eight characters or more that the fix adds (``added``, without
    blanks) go; what is longer than ``most`` characters is cut at a blank and marked.
    """

    def kind(s: Column) -> Column:
        bare = F.regexp_replace(s, r"\s+", "")
        leaks = (F.length(bare) >= 8) & F.array_contains(added, bare)
        return F.when(s == "", "").when(s.rlike(TRAILER) | s.rlike(REFERENCE), "trailer").when(s.rlike(DIFF_LINE), "code").when(leaks, "leak").otherwise("")

    def done(rows: Column) -> Column:
        count = lambda k: F.size(F.filter(rows, lambda r: r["kind"] == k)).alias(k)
        kept = F.array_join(F.transform(F.filter(rows, lambda r: r["kind"] == ""), lambda r: r["s"]), "\n")
        whole = strip(F.regexp_replace(kept, r"\n{3,}", "\n\n"))
        cut = F.concat(F.regexp_replace(F.substring(whole, 1, most), r"(?s) [^ ]*\z", ""), F.lit(" [...]"))
        return F.struct(F.when(F.length(whole) > most, cut).otherwise(whole).alias("cleaned"), count("code"), count("leak"), count("trailer"), (F.length(whole) > most).alias("truncated"))

    rows = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda line: F.struct(strip(line).alias("s"), kind(strip(line)).alias("kind")))
    return let(rows, done)


def resolve_link(link: Column, forges: dict[str, str], mirrors: dict[str, str]) -> Column:
    """Struct of ``kind``, ``repo`` and ``sha`` of a link to a change, null for unknown hosts.

    ``forges`` maps repositories of the freedesktop host to their new names, ``mirrors`` parts of links to repositories.
    """

    def found(kind: str, pattern: str, repo=None) -> Column:
        name, sha = F.regexp_extract(link, pattern, 1), F.regexp_extract(link, pattern, 2)
        name = name if repo is None else repo(name)
        return F.when((sha != "") & name.isNotNull(), F.struct(F.lit(kind).alias("kind"), name.alias("repo"), sha.alias("sha")))

    picks = [
        found("github", r"^https?://github\.com/([^/]+/[^/]+)/(?:commit|pull/[0-9]+/commits)/([0-9a-f]{7,40})"),
        found("gsource", r"^https?://android\.googlesource\.com/(.+?)/\+/([0-9a-f]{40})"),
    ]
    if forges:
        known = F.create_map(*(F.lit(x) for pair in forges.items() for x in pair))
        picks.append(found("gitlab", r"^https?://cgit\.freedesktop\.org/(.+?)/commit/.*?id=([0-9a-f]{40})", lambda n: F.try_element_at(known, n)))
    sha = F.regexp_extract(link, r"(?:[?;&]h=|[?&]id=)([0-9a-f]{40})", 1)
    picks += [F.when(F.contains(link, F.lit(part)) & (sha != ""), F.struct(F.lit("github").alias("kind"), F.lit(repo).alias("repo"), sha.alias("sha"))) for part, repo in mirrors.items()]
    return F.coalesce(*picks)


def cues(description: Column, fix_text: Column, function: Column, stop: tuple[str, ...] = ()) -> Column:
    """Struct of what a description gives away: ``location_hits`` (at most eight names of the fix), ``names_function``, ``remedy_phrase``, ``words``."""
    names = lambda t: F.array_distinct(F.transform(identifiers(t, 4), F.lower))
    said = names(description)
    hits = F.slice(F.array_sort(F.array_except(F.array_intersect(said, names(fix_text)), F.array(*map(F.lit, stop)).cast("array<string>"))), 1, 8)
    own = (function != "") & F.array_contains(said, F.lower(function))
    return F.struct(hits.alias("location_hits"), own.alias("names_function"), F.regexp_extract(description, REMEDY, 0).alias("remedy_phrase"), F.regexp_count(description, F.lit(r"\S+")).alias("words"))


def balance(text: Column, opening: str = "(", closing: str = ")") -> Column:
    """Struct of ``depth`` at the end, and ``low``, the least depth on the way."""
    kept = F.regexp_replace(text, rf"[^\{opening}\{closing}]", "")
    chars = F.filter(F.split(kept, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == opening, 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.least(acc["low"], depth).alias("low"))

    return F.aggregate(chars, start, step)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays of different elements; ``empty`` for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common.cast("double"), (F.size(a) + F.size(b) - common).cast("double")), F.lit(empty))
