"""Source code as column expressions: slices, statements as multisets, verdicts on patches and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.text import CODE_TOKEN, IDENTIFIER, canonical_code, jaccard, let

# Calls and subscripts that a slice starts from, and what counts as no statement.
SINK = r"\bstrcpy\b|\bstrcat\b|\bmemcpy\b|\bsprintf\b|\bgets\b|\bmalloc\b|\bfree\b|\[\s*\w+\s*\]"
NO_STATEMENT = ("", "{", "}", "};")
# Words that are no call, and identifiers that say nothing about an edit.
NO_CALL = ("if", "while", "for", "switch", "sizeof", "return")
PLAIN_NAMES = ("int", "char", "return", "NULL", "sizeof", "const", "unsigned", "struct", "goto")
CONTROL = r"^(if\b|else\b|return\b|goto\b|break\b|continue\b|\}|\{)"
SKELETON = r"\b\d+\b|[<>=!]=?|&&|\|\||[+\-*/%&|^~]|\s+"
#: Similarity of slices from which a patch has left the vulnerable slice as it was.
INTACT = 0.90
_LINE = r"\r\n|\r|\n"


def _strings() -> Column:
    return F.array().cast("array<string>")


def code_lines(text: Column) -> Column:
    """Lines without the empty one that a final line break leaves; none for an empty text."""
    return F.when(text == "", _strings()).otherwise(F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), _LINE))


def slice_rows(text: Column) -> Column:
    """The stripped lines that touch a sink, and all that share an identifier with them.

    A text without a sink starts from its lines with ``=`` or ``(`` instead.
    """

    def names(rows: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(rows, lambda s: F.regexp_extract_all(s, F.lit(IDENTIFIER), F.lit(0)))))

    def chosen(rows: Column) -> Column:
        def from_start(start: Column) -> Column:
            return let(names(start), lambda n: F.filter(rows, lambda s: F.array_contains(start, s) | F.arrays_overlap(F.regexp_extract_all(s, F.lit(IDENTIFIER), F.lit(0)), n)))

        sinks = F.filter(rows, lambda s: s.rlike(SINK))
        other = F.filter(rows, lambda s: s.contains("=") | s.contains("("))
        return let(let(sinks, lambda s: F.when(F.size(s) > 0, s).otherwise(other)), from_start)

    stripped = F.transform(code_lines(text), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return let(F.filter(stripped, lambda s: s != ""), chosen)


def slice_tokens(text: Column) -> Column:
    """Different tokens of the canonical slice; one mark for an empty slice."""
    found = F.array_distinct(F.regexp_extract_all(canonical_code(F.array_join(slice_rows(text), "\n")), F.lit(CODE_TOKEN), F.lit(0)))
    return let(found, lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("_empty_"))))


def slice_similarity(a: Column, b: Column) -> Column:
    return let(slice_tokens(a), lambda x: let(slice_tokens(b), lambda y: jaccard(x, y)))


def statements(text: Column) -> Column:
    """Lines without comments and blanks, in order, but for those of nothing but a brace."""
    bare = F.transform(F.split(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), _LINE), lambda s: F.regexp_replace(F.regexp_replace(s, r"//.*", ""), r"\s+", ""))
    return F.filter(bare, lambda s: ~s.isin(*NO_STATEMENT))


def tagged(rows: Column) -> Column:
    """A multiset as a set: each element with the number of its equals before it, so that set functions count."""
    return let(F.array_sort(rows), lambda r: F.transform(r, lambda s, i: F.concat(s, F.lit("#"), (i + 1 - F.array_position(r, s)).cast("string"))))


def minus(a: Column, b: Column) -> Column:
    """Multiset difference: each element of ``a`` as often as it stands there more than in ``b``."""
    return untagged(F.array_except(tagged(a), tagged(b)))


def untagged(rows: Column) -> Column:
    """The elements of a multiset that ``tagged`` has made a set."""
    return F.transform(rows, lambda s: F.regexp_replace(s, r"#[0-9]+\z", ""))


def balanced(text: Column) -> Column:
    """Braces never close what is not open, close all in the end, and there is one at least.

    Texts whose braces differ in number need no look at their order.
    """
    braces = F.filter(F.split(F.regexp_replace(text, r"[^{}]", ""), ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "{", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.least(acc["low"], depth).alias("low"))

    opened = F.regexp_count(text, F.lit(r"\{"))
    low = F.aggregate(braces, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")), step, lambda end: end["low"])
    return F.when((opened > 0) & (opened == F.regexp_count(text, F.lit(r"\}"))), low == 0).otherwise(False)


def proper_subset(a: Column, b: Column) -> Column:
    """Whether the different elements of ``a`` are some, but not all, of those of ``b``."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) > 0)


def edit_kind(removed: Column, added: Column) -> Column:
    """What an edit does: adds guards, changes bounds, changes which functions are called, or other."""

    def skeletons(rows: Column) -> Column:
        return F.array_sort(F.transform(rows, lambda s: F.regexp_replace(s, SKELETON, "")))

    def calls(rows: Column) -> Column:
        found = F.flatten(F.transform(rows, lambda s: F.regexp_extract_all(s, F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))))
        return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, NO_CALL))))

    guards = F.forall(added, lambda s: s.rlike(CONTROL) | s.contains("return"))
    none, some = F.size(removed) == 0, F.size(added) > 0
    return (
        F.when(none & some & guards, "guard")
        .when(~none & some & (skeletons(removed) == skeletons(added)), "bound")
        .when(calls(removed) != calls(added), "call").otherwise("other")
    )


def edit_names(rows: Column) -> Column:
    """Different identifiers of three letters or more that statements use."""
    found = F.flatten(F.transform(rows, lambda s: F.regexp_extract_all(s, F.lit(r"[A-Za-z_]\w{2,}"), F.lit(0))))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, PLAIN_NAMES)))


def function_name(text: Column) -> Column:
    """The word before the first parameter list that a brace follows, else empty."""
    return F.coalesce(F.regexp_extract(text, r"(?s)([A-Za-z_]\w*)\s*\([^;{]*\)\s*\{", 1), F.lit(""))


def bare_code(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", " "), r"\s+", "")


def longest_fence(text: Column) -> Column:
    """The longest fenced code block, the first among equals, without line feeds around it; else empty."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```(?:c|C|cpp)?\s*\n(.*?)```"), F.lit(1))
    longest = F.aggregate(blocks, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.regexp_replace(longest, r"^\n+|\n+\z", "")


def static_issues(candidate: Column, vulnerable: Column) -> Column:
    """Which of five checks a candidate fails, without its fix being known: an array of names."""

    def count(text: Column, one: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(one)))

    want = function_name(vulnerable)
    checks = F.array(
        F.when(bare_code(candidate) == bare_code(vulnerable), "unchanged"),
        F.when(count(candidate, "{") != count(candidate, "}"), "unbalanced_braces"),
        F.when(count(candidate, "(") != count(candidate, ")"), "unbalanced_parentheses"),
        F.when((want != "") & (function_name(candidate) != want), "renamed_function"),
    )
    return F.when(candidate == "", F.array(F.lit("no_code_block"))).otherwise(F.array_compact(checks))


def intact_rows(candidate: Column, vulnerable: Column, most: int = 12) -> Column:
    """Slice lines of the vulnerable text that still stand in the candidate, at most so many."""
    return intact_among(candidate, slice_rows(vulnerable), most)


def intact_among(candidate: Column, rows: Column, most: int = 12) -> Column:
    """Those of the lines, at most so many, that still stand in the candidate."""

    def one_blank(s: Column) -> Column:
        return F.regexp_replace(s, r"\s+", " ")

    have = F.transform(code_lines(candidate), lambda s: one_blank(F.regexp_replace(s, r"^\s+|\s+$", "")))
    return F.slice(let(have, lambda h: F.filter(rows, lambda s: F.array_contains(h, one_blank(s)))), 1, most)


def last_answer(text: Column) -> Column:
    """1 for VULNERABLE, 0 for SAFE: the last marked answer, else what the last 200 characters say."""
    up = F.upper(text)
    marked = F.regexp_extract_all(up, F.lit(r"ANSWER:\s*\**\s*(VULNERABLE|SAFE)"), F.lit(1))
    tail = F.substring(up, F.greatest(F.length(up) - 199, F.lit(1)), F.lit(200))
    loose = tail.contains("VULNERABLE") & ~tail.contains("NOT VULNERABLE")
    return F.when(F.size(marked) > 0, F.element_at(marked, -1) == "VULNERABLE").otherwise(loose).cast("int")


def first_answer(text: Column) -> Column:
    """1 or 0 by the first word if it is a verdict, else by ``last_answer``."""
    word = F.regexp_extract(F.upper(F.regexp_replace(text, r"^\s+|\s+\z", "")), r"^\W*(VULNERABLE|SAFE)\b", 1)
    return F.when(word != "", (word == "VULNERABLE").cast("int")).otherwise(last_answer(text))


def choice_answer(text: Column) -> Column:
    """A or B: the last marked answer, else the first letter, else A if one of the first five is."""
    marked = F.regexp_extract_all(F.upper(text), F.lit(r"ANSWER:\s*\**\s*([AB])"), F.lit(1))
    t = F.upper(F.regexp_replace(text, r"^\s+|\s+\z", ""))
    first = F.substring(t, 1, 1)
    loose = F.when(first.isin("A", "B", ""), first).when(F.substring(t, 1, 5).contains("A"), "A").otherwise("B")
    return F.when(F.size(marked) > 0, F.element_at(marked, -1)).otherwise(loose)


def json_label(text: Column, labels: tuple[str, ...], default: str) -> Column:
    """The label field of the JSON object that stands in a text, in one spelling, or the default."""
    found = F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), "$.label")
    spelled = F.translate(F.lower(F.trim(found)), "- ", "__")
    return F.when(spelled.isin(*labels), spelled).otherwise(default)
