"""Quality classifier: an interpolated modified Kneser-Ney n-gram model over bytes, trained on trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import vec
from assayer.llm.shared import Scratch
from assayer.operators.joins import small

#: Bytes of an n-gram; up to five fit a key beside a row number.
ORDER = 5
#: Texts are taken together up to so many bytes, and ask for each of their n-grams once; a longer text is alone.
BLOCK_BYTES = 16 << 20
#: Of the compression of blocks that travel.
LEVEL = 6
#: Share of trusted documents, by language, whose perplexity is accepted.
QUANTILE = 0.99
#: Perplexities are binned to this step of their logarithm for the quantiles.
STEP = 0.001


def _grams(chunk: vec.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, with zero bytes before a text's start, and its row."""
    row = np.repeat(np.arange(chunk.rows), np.diff(chunk.offsets))
    padded = np.zeros(len(chunk.data) + (ORDER - 1) * chunk.rows, np.uint64)
    at = np.arange(len(chunk.data)) + (ORDER - 1) * (row + 1)
    padded[at] = chunk.data
    grams = np.zeros(len(at), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        grams = (grams << np.uint64(8)) | padded[at - k]
    return grams, row


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, each = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every)
    every, each = every[order], each[order]
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), every[1:] != every[:-1]]))
    return every[first], np.add.reduceat(each, first)


def _tally(chunks: Iterator[vec.Chunk]) -> Iterator[pa.RecordBatch]:
    """``gram`` and ``n``, added up over the chunks as far as memory allows."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(counts[0])], ["gram", "n"])

    for chunk in chunks:
        if not len(chunk.data):
            continue
        grams = np.sort(_grams(chunk)[0])
        first = np.flatnonzero(np.concatenate([np.ones(1, bool), grams[1:] != grams[:-1]]))
        keys.append(grams[first])
        counts.append(np.diff(np.append(first, len(grams))))
        if sum(map(len, keys)) > 2_000_000:
            keys[:], counts[:] = ([x] for x in _merged(keys, counts))
            if len(keys[0]) > 1_500_000:
                yield out()
                keys, counts = [], []
    if keys:
        keys[:], counts[:] = ([x] for x in _merged(keys, counts))
        yield out()


def gram_counts(texts: DataFrame) -> DataFrame:
    """``gram`` and ``n`` over all rows of the single column; tasks add up what they hold before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tally(chunk for batch in batches for chunk in vec.chunks(batch.column(0)))

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """The rows of ``text`` and further columns in blocks: ``block``, the further columns as arrays, ``data`` and ``sizes``.

    A block travels as one row of compressed text.  Its number is a hash of its place and content: a plan that reads
    the rows again in the same partitions numbers them alike.
    """
    names = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=LEVEL)
        for chunk, columns in _numbered(batches, size):
            whole = [pa.ListArray.from_arrays(pa.array([0, chunk.rows], pa.int32()), c) for c in columns[1:]]
            data = codec.compress(chunk.data.tobytes(), asbytes=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([columns[0]]), *whole, pa.array([data], pa.binary()), pa.array([np.diff(chunk.offsets)], pa.list_(pa.int64()))], ["block", *names, "data", "sizes"]
            )

    kinds = [f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in names]
    return rows.mapInArrow(run, ", ".join(["block long", *kinds, "data binary, sizes array<long>"]))


def _numbered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[vec.Chunk, list]]:
    """Blocks of the batches' first column, each with its number and the other columns' rows."""
    at = f"{TaskContext.get().partitionId()} ".encode()
    count = 0
    for batch in batches:
        for chunk in vec.chunks(batch.column(0), size):
            count += 1
            number = xxhash.xxh3_64(at + str(count).encode())
            number.update(np.ascontiguousarray(chunk.offsets).tobytes())
            number.update(chunk.data.tobytes())
            yield chunk, [number.intdigest() - (1 << 63), *(c.slice(chunk.first, chunk.rows) for c in batch.columns[1:])]


def _parts(block: vec.Chunk) -> Iterator[vec.Chunk]:
    """A block cut into chunks of whole texts, as they fit the processor's caches."""
    return vec.chunks(pa.Array.from_buffers(pa.large_utf8(), block.rows, [None, pa.py_buffer(np.ascontiguousarray(block.offsets)), pa.py_buffer(np.ascontiguousarray(block.data))]))


def _opened(data: bytes, sizes: np.ndarray) -> Iterator[vec.Chunk]:
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    text = pa.decompress(data, decompressed_size=int(offsets[-1]), codec="zstd")
    return vec.chunks(pa.Array.from_buffers(pa.large_utf8(), len(sizes), [None, pa.py_buffer(offsets), text]))


def trusted_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The n-gram counts of the documents whose id is in ``trusted`` and not held out.

    Ids alone are joined to the labels; the blocks then learn which of their texts count.
    """
    rows = docs.where(~held_out(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    blocks = _blocks(rows, block_bytes)
    each = blocks.select("block", F.posexplode("id").alias("at", "id"))
    wanted = each.join(trusted.hint("merge"), "id", "left_semi").groupBy("block").agg(F.collect_list("at").alias("at"))
    some = blocks.select("block", "data", "sizes").join(wanted.hint("merge"), "block").select("data", "sizes", "at")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[vec.Chunk]:
        for batch in batches:
            for data, sizes, at in zip(*batch.columns):
                use = np.zeros(len(sizes), bool)
                use[at.values.to_numpy()] = True
                for chunk in _opened(data.as_py(), sizes.values.to_numpy()):
                    mine = use[chunk.first : chunk.first + chunk.rows]
                    size = np.diff(chunk.offsets)
                    yield vec.Chunk(0, chunk.data[np.repeat(mine, size)], np.append(0, np.cumsum(size[mine])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tally(chosen(batches))

    return some.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """The discounts of counts 1, 2 and 3 or more, from how many n-grams have a count of 1 to 4."""
    n1, n2, n3, n4 = counts.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first()
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(found, (1, 2, 3))]


def train(texts: DataFrame) -> DataFrame:
    """The model of the texts in the single column, see ``model_of``."""
    return model_of(gram_counts(texts))


def model_of(grams: DataFrame) -> DataFrame:
    """The model, a row for every n-gram and context seen: ``size``, ``gram``, ``logp``, ``logb``.

    ``logp`` is the interpolated log-probability of the last byte of a seen n-gram of that size, ``logb``
    the weight that its context gives the shorter n-gram of one that was not seen (with ``gram`` then
    the context of ``size`` - 1 bytes).  The highest order counts occurrences, the lower orders count in how many n-grams
    of the next higher order a gram is the ending.  All counts are joined in shards by n-gram.
    """
    scratch = Scratch(grams.sparkSession)
    counts = {ORDER: scratch.write(grams)}
    for size in range(ORDER - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << (8 * size)) - 1))
        counts[size] = scratch.write(counts[size + 1].groupBy(tail.alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    total = counts[1].agg(F.sum("n")).first()[0] or 1
    # Of one byte: add one half to each of the 256, so that none is impossible.
    every = grams.sparkSession.range(256).withColumnRenamed("id", "gram").join(counts[1], "gram", "left")
    model = every.select(F.lit(1).alias("size"), "gram", ((F.coalesce("n", F.lit(0)) + 0.5) / (total + 128.0)).alias("p"))
    shorter, parts, weights = model, [model], []
    for size in range(2, ORDER + 1):
        d1, d2, d3 = _discounts(counts[size])
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.shiftrightunsigned("gram", 8).alias("context")
        by_context = counts[size].groupBy(context).agg(F.sum("n").alias("all"), F.sum(discount).alias("off"))
        weight = by_context.select("context", "all", (F.col("off") / F.col("all")).alias("b"))
        tail = F.col("gram").bitwiseAND(F.lit((1 << (8 * (size - 1))) - 1))
        seen = counts[size].select("gram", "n", context, tail.alias("tail")).join(weight, "context")
        seen = seen.join(shorter.select(F.col("gram").alias("tail"), F.col("p").alias("less")), "tail")
        p = (F.col("n") - discount) / F.col("all") + F.col("b") * F.col("less")
        shorter = scratch.write(seen.select(F.lit(size).alias("size"), "gram", p.alias("p")))
        parts.append(shorter)
        weights.append(weight.select(F.lit(size).alias("size"), F.col("context").alias("gram"), F.log("b").cast("float").alias("logb")))
    nothing = F.lit(None).cast("float")
    out = None
    for part in parts:
        one = part.select("size", "gram", F.log("p").cast("float").alias("logp"), nothing.alias("logb"))
        out = one if out is None else out.unionByName(one)
    for part in weights:
        out = out.unionByName(part.select("size", "gram", nothing.alias("logp"), "logb"))
    return scratch.write(out)


def _resolved(grams: DataFrame, model: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """``gram`` and ``value``, the log-probability of the last byte of each of the distinct n-grams of ``size`` bytes.

    Seen ones are joined to the counts' table by n-gram; the others join the weight of their context, and the
    distinct shorter n-grams that they leave are resolved alike.
    """
    seen = model.where((F.col("size") == size) & F.col("logp").isNotNull()).select("gram", F.col("logp").alias("value"))
    if size == 1:
        return grams.join(seen, "gram")
    met = scratch.write(grams.join(seen.hint("merge"), "gram", "left"))
    back = model.where((F.col("size") == size) & F.col("logb").isNotNull()).select(F.col("gram").alias("context"), "logb")
    tail = F.col("gram").bitwiseAND(F.lit((1 << (8 * (size - 1))) - 1))
    rest = met.where("value is null").select("gram", F.shiftrightunsigned("gram", 8).alias("context"), tail.alias("tail"))
    less = _resolved(rest.select(F.col("tail").alias("gram")).distinct(), model, size - 1, scratch)
    less = less.select(F.col("gram").alias("tail"), F.col("value").alias("less"))
    unseen = rest.join(back.hint("merge"), "context", "left").join(less.hint("merge"), "tail")
    unseen = unseen.select("gram", (F.coalesce("logb", F.lit(0.0)) + F.col("less")).alias("value"))
    return met.where("value is not null").unionByName(unseen)


def perplexities(docs: DataFrame, model: DataFrame, keep: tuple[str, ...], text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of every row and its ``perplexity`` by byte, null for null and empty texts.

    Blocks of texts ask for their distinct n-grams.  These are counted down to the distinct ones of the corpus, joined
    to the model in shards of n-grams and contexts, and the values join the questions and go back to their blocks,
    which add them up by document.  No part of the model is gathered anywhere.
    """
    names = [f"keep_{k}" for k in range(len(keep))]
    rows = docs.select(F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(n) for c, n in zip(keep, names)))
    scratch = Scratch(docs.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, columns in _numbered(batches, block_bytes):
            grams = [np.unique(_grams(chunk)[0]) for chunk in _parts(block)]
            grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
            for k in range(0, len(grams), 100_000):
                some = pa.array(grams[k : k + 100_000].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), columns[0])), some], ["block", "gram"])

    asked = scratch.write(rows.mapInArrow(ask, "block long, gram long"))
    values = scratch.write(_resolved(asked.select("gram").distinct(), model, ORDER, scratch))
    answers = asked.join(values.hint("merge"), "gram").select("block", "gram", F.col("value").cast("float").alias("value"))
    kinds = [rows.schema[n].dataType.simpleString() for n in names]

    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        grams, value = answers["gram"].to_numpy().view(np.uint64), answers["value"].to_numpy()
        by = np.argsort(grams)
        grams, value = grams[by], value[by].astype(np.float64)
        sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        for data, size in zip(blocks["data"], blocks["sizes"]):
            for chunk in _opened(data.as_py(), size.values.to_numpy()):
                wanted, row = _grams(chunk)
                at = np.minimum(np.searchsorted(grams, wanted), max(0, len(grams) - 1))
                if len(wanted) and not (len(grams) and np.array_equal(grams[at], wanted)):
                    raise ValueError("a block was numbered otherwise when it was read again: give a table that reads alike each time")
                sums.append(np.bincount(row, value[at] if len(wanted) else None, chunk.rows))
                sizes.append(np.diff(chunk.offsets))
        columns = [pa.chunked_array([c.values for c in blocks[n]], blocks[n].type.value_type) for n in names]
        return pa.table([*columns, pa.array(np.concatenate(sums), pa.float64()), pa.array(np.concatenate(sizes), pa.int64())], [*names, "logp", "bytes"])

    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), "logp double", "bytes long"])
    found = _blocks(rows, block_bytes).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
    perplexity = F.when(F.col("bytes") > 0, F.exp(-F.col("logp") / F.col("bytes")))
    return found.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), perplexity.alias("perplexity"))


def quantile_by(scored: DataFrame, group: str, quantile: float, step: float = STEP) -> DataFrame:
    """``group`` and the perplexity that the given share of its rows does not exceed, by bins of its logarithm."""
    bins = scored.where("perplexity is not null").groupBy(group, F.ceil(F.log("perplexity") / step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(group)
    up_to = F.sum("n").over(by.orderBy("bin"))
    reached = bins.select(group, "bin", up_to.alias("up_to"), F.sum("n").over(by).alias("all"))
    return reached.where(F.col("up_to") >= quantile * F.col("all") - 1e-9).groupBy(group).agg(F.exp(F.min("bin") * step).alias("threshold"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    label_col: str = "quality", quantile: float = QUANTILE,
) -> DataFrame:
    """One row per document: id, language, ``perplexity``, the ``threshold`` of its language, ``kept``.

    Trusted are the documents whose label is 1; two thirds of them, by a checksum of the id, train the
    model, and the others' perplexities give each language's threshold, the ``quantile`` of them.  A
    language without any takes the quantile over all languages.  Counts cover all trusted text.

    Null and empty texts have no perplexity and are not kept; repeated labels of an id count as 1 where
    any is; a null language is a language of its own; without trusted text nothing has a threshold and
    all texts are kept.
    """
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct()
    model = model_of(trusted_counts(docs, trusted, id_col, text_col))
    scratch = Scratch(docs.sparkSession)
    scored = scratch.write(perplexities(docs, model, (id_col, lang_col), text_col).select(F.col(id_col).alias("id"), F.coalesce(lang_col, F.lit("")).alias("lang"), F.col(lang_col).alias("own"), "perplexity"))
    known = scored.where(held_out(F.col("id"))).join(trusted, "id", "left_semi").select("lang", "perplexity")
    by_lang = quantile_by(known, "lang", quantile)
    overall = quantile_by(known.withColumn("lang", F.lit("all")), "lang", quantile).agg(F.max("threshold").alias("any"))
    judged = scored.join(small(by_lang), "lang", "left").crossJoin(F.broadcast(overall))
    limit = F.coalesce("threshold", "any")
    kept = F.col("perplexity").isNotNull() & (limit.isNull() | (F.col("perplexity") <= limit))
    return judged.select(F.col("id").alias(id_col), F.col("own").alias(lang_col), "perplexity", limit.alias("threshold"), kept.alias("kept"))
