"""Benchmark decontamination with a broadcast hash set of test windows; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import Scratch, ascii_lower
from assayer.operators.joins import small

#: Beyond so many distinct windows the hash set is not broadcast but joined by a shuffle.
MAX_BROADCAST_WINDOWS = 1_000_000
#: Beyond so many hit documents their keys are not broadcast either.
MAX_BROADCAST_HITS = 1_000_000


def words(text: Column) -> Column:
    """Runs of digits, a-z and non-ASCII characters, after A-Z are lower-cased; null has none."""
    parts = F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def _hash(tokens: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*(F.get(tokens, start + k) for k in range(length)))


def item_windows(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct windows of the test items: ``tokens``, ``width``, ``key`` and the ``items`` with it."""
    item = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (n - 1), F.lit(1)))
    each = item.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, n))).alias("tokens"))
    sets = each.groupBy("tokens").agg(F.array_sort(F.collect_set("item")).alias("items"))
    key = F.coalesce(*(F.when(F.size("tokens") == k, _hash(F.col("tokens"), F.lit(0), k)) for k in range(n, 0, -1)))
    return sets.select("tokens", F.size("tokens").alias("width"), key.alias("key"), "items")


def find_hits(
    docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document row: id, ``n_words``, ``hits`` (array of start and width in words) and ``items``.

    Every document position is hashed with its ``n`` following words, inside generated code, and looked
    up in the broadcast hash set; equal hashes are verified word by word.  Each document also sends one
    marker row, so that one pass and one shuffle of the markers and hits give all documents.

    An item of fewer words than ``n`` is one window; null and wordless texts have no windows and no
    hits; repeated document rows each keep a row; an item id of null counts as no item.
    """
    return _find(docs, items, n, id_col, text_col, item_id, item_text, ()).withColumnRenamed("id", id_col)


def _find(
    docs: DataFrame, items: DataFrame, n: int, id_col: str, text_col: str, item_id: str, item_text: str, carry: tuple[str, ...]
) -> DataFrame:
    """As ``find_hits``, with ``id`` and the columns ``carry`` as carry_0, carry_1, ..., which the marker takes along."""
    windows = item_windows(items, item_id, item_text, n)
    sizes = {r["width"]: r["n"] for r in windows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}  # n rows at most
    widths = sorted(sizes) or [n]
    few = sum(sizes.values()) <= MAX_BROADCAST_WINDOWS
    if few:
        windows = F.broadcast(windows)
    row = docs.select(
        F.col(id_col).alias("id"), *(F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)), words(F.col(text_col)).alias("all")
    ).withColumn("row", F.monotonically_increasing_id())
    last = F.greatest(F.size("all") - widths[0], F.lit(-1))
    row = row.withColumn("at", F.explode(F.sequence(F.lit(-1), last)))
    if len(widths) == 1:
        row = row.withColumn("key", F.when(F.col("at") >= 0, _hash(F.col("all"), F.col("at"), widths[0])))
        row = row.withColumn("wide", F.lit(widths[0]))
    else:
        each = F.array(*(F.struct(F.lit(w).alias("wide"), F.when((F.col("at") >= 0) & (F.col("at") + w <= F.size("all")), _hash(F.col("all"), F.col("at"), w)).alias("key")) for w in widths))
        row = row.withColumn("one", F.explode(each)).withColumns({"key": F.col("one.key"), "wide": F.col("one.wide")}).drop("one")
        row = row.where((F.col("at") >= 0) | (F.col("wide") == widths[0]))
    row = row.withColumn("size", F.when(F.col("at") < 0, F.size("all")))
    if not few:  # positions are shuffled with the words of their window alone, not with the whole text's
        window = F.slice(F.array(*(F.get("all", F.col("at") + k) for k in range(n))), 1, F.col("wide"))
        row = row.withColumn("mine", F.when(F.col("at") >= 0, window)).drop("all")
    found = row.join(windows, (row["key"] == windows["key"]) & (row["wide"] == windows["width"]), "left")
    # As a filter, not a join key: else the slice is made for every position instead of the few with an equal hash.
    mine = F.slice(row["all"], F.greatest(row["at"], F.lit(0)) + 1, row["wide"]) if few else row["mine"]
    same = mine == windows["tokens"]
    found = found.where((row["at"] < 0) | (windows["width"].isNotNull() & same))
    marker = F.col("at") < 0
    kept = found.select(
        row["row"], row["id"], row["size"].alias("n_words"),
        *(F.when(marker, F.col(f"carry_{k}")).alias(f"carry_{k}") for k in range(len(carry))),
        F.when(~marker, F.struct(F.col("at").alias("start"), F.col("wide").alias("width"))).alias("hit"), windows["items"].alias("items"),
    )
    found = kept.groupBy("row").agg(
        F.first("id", ignorenulls=True).alias("id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set("hit")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        *(F.first(f"carry_{k}", ignorenulls=True).alias(f"carry_{k}") for k in range(len(carry))),
    )
    return found.drop("row")


def covered(hits: Column) -> Column:
    """Distinct word positions inside the hits."""
    spans = F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["width"] - 1))
    return F.array_distinct(F.flatten(spans))


def _with_hits(docs: DataFrame, items: DataFrame, n: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, Column]]:
    """The documents with their hits, and where each of their columns is."""
    rest = [c for c in docs.columns if c != id_col]
    found = _find(docs, items, n, id_col, text_col, "item_id", "text", tuple(rest))
    return found, {c: F.col("id" if c == id_col else f"carry_{rest.index(c)}") for c in docs.columns}


def remove_documents(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any hit, with all their columns.

    Only the ids and text hashes of the hit ones move; they are counted before they are broadcast.  Repeated rows of
    an id are judged each by its own text.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    pair = F.struct("id", "print")
    hits = find_hits(keyed.select(pair.alias("key"), "text").where("text is not null"), items, n, "key", "text").where(F.size("hits") > 0)
    bad = small(Scratch(docs.sparkSession).write(hits.select("key.*").distinct()), MAX_BROADCAST_HITS)
    met = docs[id_col].eqNullSafe(bad["id"]) & (F.xxhash64(docs[text_col]) == bad["print"])
    return docs.join(bad, met, "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents; the words inside hits are cut out with the separators that follow them.

    Documents without hits keep their text byte for byte.
    """
    found, columns = _with_hits(docs, items, n, id_col, text_col)
    text = columns[text_col]
    piece = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all(text, F.lit(piece), F.lit(0))
    lead = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    marked = found.withColumns({"gone": covered(F.col("hits")), "pieces": pieces})
    left = F.filter("pieces", lambda p, k: ~F.array_contains("gone", k))
    columns[text_col] = F.when(F.size("hits") == 0, text).otherwise(F.concat(lead, F.array_join(left, "")))
    return marked.select(*(at.alias(c) for c, at in columns.items()))
