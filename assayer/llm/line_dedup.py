"""Line deduplication by an exact set-similarity join of the lines' word sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import vec
from assayer.llm.shared import Scratch, numbered

SIMILARITY = 0.8
#: Words are counted by the top bits of their code; the order by these counts need only be the same everywhere.
COUNT_BITS = 16
_CODE_BITS = 44
_LOW = np.uint64(_CODE_BITS - COUNT_BITS)
#: Lines that a candidate pair names are marked in so many bits, to fetch their words.
MARK_BITS = 22
#: Candidates that each word of a set tries first: a few where the best is convincing, by at most CLOSE of
#: the 128 parity bits and half of what the similarity allows, else many.
TRIED, MANY, CLOSE = 16, 400, 40
#: The postings of a word are compared over so many places at first.
LAG = 20_000
#: Postings that are compared at a time, and the rest of the last one's word.
TOGETHER = 200_000
_MOST = (1 << 20) - 1
#: Rows are hashed together up to so many bytes, whose arrays stay in cache.
PIECE = 1 << 18
_TABLE = vec.byte_class("all but blanks")


@dataclass
class Lines:
    """The lines of a chunk that have words: their distinct words lie at ``first`` to ``first + n`` of ``codes``."""

    row: np.ndarray
    line: np.ndarray
    first: np.ndarray
    n: np.ndarray
    codes: np.ndarray
    key1: np.ndarray
    key2: np.ndarray


def _lines(chunk: vec.Chunk, rank: np.ndarray | None = None, back: np.ndarray | None = None) -> Lines:
    """``rank`` replaces a code's top bits by their rank, so that each line's codes come rarest first."""
    found, at, codes = [], 0, 0
    while at < chunk.rows:
        to = max(at + 1, int(np.searchsorted(chunk.offsets, chunk.offsets[at] + PIECE, "right")) - 1)
        begin, end = chunk.offsets[at], chunk.offsets[to]
        got = _piece(vec.Chunk(0, chunk.data[begin:end], chunk.offsets[at : to + 1] - begin), rank, back)
        got.row += at
        got.first += codes
        codes += len(got.codes)
        found.append(got)
        at = to
    if len(found) == 1:
        return found[0]
    return Lines(*(np.concatenate([getattr(x, f.name) for x in found]) for f in fields(Lines)))


def _piece(chunk: vec.Chunk, rank: np.ndarray | None, back: np.ndarray | None) -> Lines:
    w = vec.words(chunk, _TABLE)
    breaks = np.flatnonzero(chunk.data == 10)
    of_row = np.searchsorted(chunk.offsets, breaks, "right") - 1
    per_row = np.bincount(of_row, minlength=chunk.rows) + 1
    base = np.cumsum(per_row) - per_row
    line_of = vec.parts(w.starts, breaks) + w.row
    codes = vec.Hasher(w.low)(w.starts, w.ends) >> np.uint64(64 - _CODE_BITS)
    if rank is not None:
        codes = (rank[codes >> _LOW] << _LOW) | (codes & np.uint64((1 << int(_LOW)) - 1))
    room = np.uint64(_CODE_BITS)
    if len(line_of) and int(line_of[-1]) >> (64 - _CODE_BITS):  # one row of over a million lines
        order = np.lexsort((codes, line_of))
        line_s, codes = line_of[order], codes[order]
    else:
        both = np.sort((line_of.astype(np.uint64) << room) | codes)
        line_s, codes = (both >> room).astype(np.int64), both & np.uint64((1 << _CODE_BITS) - 1)
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (line_s[1:] != line_s[:-1])
    line_s, codes = line_s[new], codes[new]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(line_s)), bool), line_s[1:] != line_s[:-1]]))
    n = np.diff(np.append(first, len(line_s)))
    plain = codes if back is None else (back[codes >> _LOW] << _LOW) | (codes & np.uint64((1 << int(_LOW)) - 1))
    sums = [np.zeros(0, np.uint64)] * 2
    if len(first):
        one = vec.mix(plain + np.uint64(1))
        sums = [vec.mix(np.add.reduceat(x, first)) for x in (one, vec.mix(one ^ np.uint64(0x5851F42D4C957F2D)))]
    which = line_s[first]
    row = np.searchsorted(base, which, "right") - 1
    return Lines(row, which - base[row], first, n, codes, *sums)


def _rows_with(texts: pa.Array, marks: np.ndarray) -> np.ndarray:
    """The rows that hold a marked word: without sorting or lines, half the work of cutting all rows."""
    found = [np.zeros(0, np.int64)]
    for chunk in vec.chunks(texts, PIECE):
        w = vec.words(chunk, _TABLE)
        codes = vec.Hasher(w.low)(w.starts, w.ends) >> np.uint64(64 - _CODE_BITS)
        found.append(chunk.first + np.unique(w.row[marks[codes & np.uint64((1 << MARK_BITS) - 1)]]))
    return np.concatenate(found)


def _scan(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for every line (``id``, ``line``, ``key1``, ``key2``), and at ``line`` -1 how many words a task had by code."""
    rows, kind = _scan(docs, id_col, text_col)
    names = ["id", "line", "key1", "key2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, of_id = np.zeros(1 << COUNT_BITS, np.int64), None
        for batch in batches:
            of_id = batch.column(0).type
            for chunk in vec.chunks(batch.column(1)):
                got = _lines(chunk)
                top = (got.codes >> _LOW).astype(np.int64)
                count += np.bincount(top, minlength=1 << COUNT_BITS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(chunk.first + got.row)), pa.array(got.line.astype(np.int32)), pa.array(got.key1.view(np.int64)), pa.array(got.key2.view(np.int64))], names
                )
        some = np.flatnonzero(count)
        if of_id is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), of_id), pa.array(np.full(len(some), -1, np.int32)), pa.array(some), pa.array(count[some])], names)

    return rows.mapInArrow(run, f"id {kind}, line int, key1 long, key2 long")


def _ranks(occurrences: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every code bucket by its count, and back; 65,536 numbers at any size of the corpus."""
    counts = occurrences.where("line = -1").groupBy("key1").agg(F.sum("key2").alias("n")).toPandas()
    count = np.zeros(1 << COUNT_BITS, np.int64)
    count[counts["key1"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    back = np.argsort(count, kind="stable").astype(np.uint64)
    rank = np.empty_like(back)
    rank[back.astype(np.int64)] = np.arange(len(back), dtype=np.uint64)
    return rank, back


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def _order(id: Column) -> Column:
    """What documents are ordered by: an integer id, null first."""
    return F.coalesce(id.cast("long"), F.lit(-(1 << 63)))


def _postings(docs: DataFrame, id_col: str, text_col: str, rank: np.ndarray, back: np.ndarray, t: float, wide: bool, only: np.ndarray | None = None) -> DataFrame:
    """Prefix words of every line: ``word``, ``key1``, ``meta``, ``ord`` and two parity bitmaps of the set.

    ``meta`` holds the set's size, the word's place in the rarity order (a lower one beyond a million, which only loosens the
    position filter) and the line's number; ``wide``: numbers beyond 20 bits have a column of their own.  ``only`` marks the
    words that are wanted; rows without any aren't cut into lines.
    """
    packed = None if only is None else np.packbits(only)
    rows = docs.select(_order(F.col(id_col)).alias("ord"), F.col(text_col).cast("string").alias("text"))
    names = ["word", "key1", "meta", "ord", "bits1", "bits2", *(["line"] if wide else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None if packed is None else np.unpackbits(packed).astype(bool)
        for batch in batches:
            orders, texts = batch.column(0).to_numpy(), batch.column(1)
            if marks is not None:  # their bits are the same whatever the rank
                some = _rows_with(texts, marks)
                orders, texts = orders[some], texts.take(pa.array(some))
            seen, seen_ord = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for chunk in vec.chunks(texts):
                got = _lines(chunk, rank, back)
                at = orders[chunk.first + got.row]
                # A line that repeats within the batch is posted once, at its first occurrence.
                by = np.lexsort((got.line, at, got.key1))
                key = got.key1[by]
                one = by[np.concatenate([np.ones(min(1, len(by)), bool), key[1:] != key[:-1]])]
                if len(seen) and len(one):
                    place = np.minimum(np.searchsorted(seen, got.key1[one]), len(seen) - 1)
                    one = one[(seen[place] != got.key1[one]) | (seen_ord[place] > at[one])]
                if not len(one):
                    continue
                keys, ords = np.concatenate([seen, got.key1[one]]), np.concatenate([seen_ord, at[one]])
                by = np.lexsort((ords, keys))
                keys, ords = keys[by], ords[by]
                fresh = np.concatenate([np.ones(1, bool), keys[1:] != keys[:-1]])
                seen, seen_ord = keys[fresh], ords[fresh]
                starts = got.first
                flat = vec.mix(got.codes + np.uint64(77))
                side = (flat >> np.uint64(6)) & np.uint64(1)
                bit = np.uint64(1) << (flat & np.uint64(63))
                spans = np.stack([starts, starts + got.n], 1).ravel()
                pad = np.zeros(1, np.uint64)
                bits = [np.bitwise_xor.reduceat(np.concatenate([np.where(side == s, bit, np.uint64(0)), pad]), spans)[::2] for s in (np.uint64(0), np.uint64(1))]
                n = got.n[one]
                # So few words have no similar set but their own: one word more or less is too far.
                size = np.where(n * (1 - t) < t - 1e-9, 0, n - _ceil(t * n) + 1)
                line = np.repeat(one, size)
                place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
                number = got.line[line].astype(np.int64)
                meta = (got.n[line] << 40) | (np.minimum(place, _MOST) << 20) | (0 if wide else number)
                columns = (got.codes[starts[line] + place], got.key1[line], meta, at[line], *(b[line] for b in bits), *((number,) if wide else ()))
                if marks is not None:
                    use = marks[columns[0] & np.uint64((1 << MARK_BITS) - 1)]
                    columns = tuple(c[use] for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _best(later: np.ndarray, earlier: np.ndarray, differ: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the pairs of each later row those that differ least, and whether there were more; ``room``: bits that may differ."""
    by = np.lexsort((differ, later))
    later, earlier, differ, room = later[by], earlier[by], differ[by], room[by]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(later)), bool), later[1:] != later[:-1]]))
    count = np.diff(np.append(first, len(later)))
    sure = (differ[first] <= CLOSE) & (2 * differ[first] <= room[first])
    most = np.where(sure, TRIED, MANY)
    keep = np.arange(len(later)) - np.repeat(first, count) < np.repeat(most, count)
    return later[keep], earlier[keep], differ[keep], room[keep], np.repeat(count > most, count)[keep]


def _pairs(rows: np.ndarray, t: float, wanted: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Later key, earlier key, a word and how many bits differ, of postings in the order of word, size, place and key.

    The word is zero, but for a later row with more candidates than were taken: that comes with itself
    and the word.

    Without ``wanted`` the best few candidates of each later row, else all of the rows it marks.
    """
    word, key, meta, order = rows[:4]
    n, place, line = meta >> 40, (meta >> 20) & _MOST, _numbers(rows)
    b1, b2 = rows[4].view(np.uint64), rows[5].view(np.uint64)
    found: list[tuple[np.ndarray, ...]] = []
    more = np.zeros(len(word), bool)
    pending = 0
    # The smaller set of a similar pair shares one of so few of its words, whatever the larger one's size.
    left = np.flatnonzero(n - place >= _ceil(2 * t / (1 + t) * n))
    step = 1
    while len(left):
        left = left[left + step < len(word)]
        right = left + step
        near = (word[left] == word[right]) & (n[right] * t <= n[left] + 1e-9)
        left, right = left[near], right[near]
        if wanted is None and step > LAG:
            more[left] = more[right] = True
            break
        total = n[left] + n[right]
        differ = np.bitwise_count(b1[left] ^ b1[right]).astype(np.int64) + np.bitwise_count(b2[left] ^ b2[right])
        some = np.flatnonzero(differ * (1 + t) <= total * (1 - t) + 1e-6)
        a, b, differ = left[some], right[some], differ[some]
        need = _ceil(t / (1 + t) * total[some])
        ok = (1 + np.minimum(n[a] - place[a] - 1, n[b] - place[b] - 1) >= need) & (differ <= total[some] - 2 * need)
        a, b, differ = a[ok], b[ok], differ[ok]
        after = (order[a] > order[b]) | ((order[a] == order[b]) & ((line[a] > line[b]) | ((line[a] == line[b]) & (key[a] > key[b]))))
        later, earlier = np.where(after, a, b), np.where(after, b, a)
        if wanted is not None:
            use = wanted[key[later] & ((1 << MARK_BITS) - 1)]
            if use.any():
                yield key[later[use]], key[earlier[use]], np.zeros(int(use.sum()), np.int64), differ[use]
        elif len(later):
            found.append((later, earlier, differ, (total[some] - 2 * need)[ok]))
            pending += len(later)
            if pending > 2_000_000:
                *best, rest = _best(*(np.concatenate(x) for x in zip(*found)))
                more[best[0][rest]] = True
                found, pending = [tuple(best)], 0
        step += 1
    if found:
        later, earlier, differ, _, rest = _best(*(np.concatenate(x) for x in zip(*found)))
        more[later[rest]] = True
        yield key[later], key[earlier], np.zeros(len(later), np.int64), differ
    if more.any():
        yield key[more], key[more], word[more], np.zeros(int(more.sum()), np.int64)


def _numbers(rows: np.ndarray) -> np.ndarray:
    """The lines' numbers of postings."""
    return rows[6] if len(rows) > 6 else rows[2] & _MOST


def _grouped(rows: np.ndarray) -> np.ndarray:
    """Postings sorted by word, in the order of word, size, place and key; of equal sets the first occurrence.

    Words of one set only are left out.
    """
    tied = rows[0, 1:] == rows[0, :-1]
    edge = np.ones(min(1, rows.shape[1]), bool)
    rows = rows[:, ~(np.concatenate([edge, ~tied]) & np.concatenate([~tied, edge]))]
    if not rows.shape[1]:
        return rows
    group = np.concatenate([[0], np.cumsum(rows[0, 1:] != rows[0, :-1])])
    rows = rows[:, np.lexsort((rows[1], rows[2] >> 20, group))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    if new.all():
        return rows
    first = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    order = np.minimum.reduceat(rows[3], first)
    line = np.minimum.reduceat(np.where(rows[3] == order[of], _numbers(rows), np.iinfo(np.int64).max), first)
    rows = rows[:, first]
    if len(rows) > 6:
        rows[6] = line
    else:
        rows[2] = (rows[2] & ~_MOST) | line
    rows[3] = order
    tied = rows[0, 1:] == rows[0, :-1]
    return rows[:, np.concatenate([[False], tied]) | np.concatenate([tied, [False]])]


def _candidates(postings: DataFrame, t: float, wanted: np.ndarray | None = None) -> DataFrame:
    """``later`` and ``earlier`` line keys that share a prefix word and pass the length, bitmap and position filters.

    Rows of a line with itself name a ``word`` at which it has further candidates.
    """
    # One sort key, which Spark sorts by its digits; the order within a word is made here.
    dealt = postings.repartition("word").sortWithinPartitions("word")
    packed = None if wanted is None else np.packbits(wanted)
    names = ["later", "earlier", "word", "differ"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None if packed is None else np.unpackbits(packed).astype(bool)

        def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows = _grouped(rows)
            if rows.shape[1]:
                for pair in _pairs(rows, t, marks):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names)

        parts, held = [], 0
        for batch in batches:
            parts.append(np.stack([c.to_numpy() for c in batch.columns]))
            held += batch.num_rows
            if held >= TOGETHER:
                rows = np.concatenate(parts, 1)
                last = int(np.searchsorted(rows[0], rows[0, -1]))
                yield from emit(rows[:, :last])
                parts, held = [rows[:, last:]], 0
        if parts:
            yield from emit(np.concatenate(parts, 1))

    return dealt.mapInArrow(run, "later long, earlier long, word long, differ long").distinct()


def _marked(keys: DataFrame) -> np.ndarray:
    """A bitmap over the low bits of the keys; its size is fixed, and a full one only fetches more lines."""
    low = keys.select((F.col("key1").bitwiseAND(F.lit((1 << MARK_BITS) - 1)) + 1).alias("x"))
    maps = low.groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros(1 << MARK_BITS, bool)
    for r in maps.collect():  # 128 rows at most; an iterator would run a job for every partition
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        out[(r.k - 1) * len(bits) : r.k * len(bits)] = bits.astype(bool)
    return out


def _word_sets(docs: DataFrame, id_col: str, text_col: str, marks: np.ndarray, homes: np.ndarray) -> DataFrame:
    """``key1`` and the word codes of the marked lines; ``homes`` marks the documents that are cut into lines for them."""
    rows = docs.select(_order(F.col(id_col)).alias("ord"), F.col(text_col).cast("string").alias("text"))
    packed, packed_homes = np.packbits(marks), np.packbits(homes)
    low = (1 << MARK_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, home = np.unpackbits(packed).astype(bool), np.unpackbits(packed_homes).astype(bool)
        for batch in batches:
            texts = batch.column(1).filter(pa.array(home[batch.column(0).to_numpy() & low]))
            for chunk in vec.chunks(texts):
                got = _lines(chunk)
                _, one = np.unique(got.key1, return_index=True)
                one = one[wanted[got.key1[one] & np.uint64(low)]]
                size = got.n[one]
                ends = np.cumsum(size)
                flat = np.repeat(got.first[one] - (ends - size), size) + np.arange(int(size.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(got.codes[flat].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(got.key1[one].view(np.int64)), lists], ["key1", "codes"])

    return rows.mapInArrow(run, "key1 long, codes array<long>").dropDuplicates(["key1"])


def _sets_of(docs: DataFrame, lines: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key1`` and the word codes of all lines in the pairs, each from one document of ``lines`` that has it."""
    scratch = Scratch(docs.sparkSession)
    keys = scratch.write(pairs.select(F.explode(F.array("later", "earlier")).alias("key1")).distinct())
    homes = lines.join(keys, "key1", "left_semi").groupBy("key1").agg(F.min(_order(F.col("id"))).alias("home"))
    found = _word_sets(docs, id_col, text_col, _marked(keys), _marked(homes.select(F.col("home").alias("key1"))))
    return scratch.write(found.join(keys, "key1", "left_semi"))


def _verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """``later`` of the pairs whose whole word sets have a Jaccard similarity of ``t`` or more."""
    x, y = (sets.select(F.col("key1").alias(c), F.col("codes").alias(n)) for c, n in (("later", "x"), ("earlier", "y")))
    both = pairs.select("later", "earlier").join(x.hint("merge"), "later").join(y.hint("merge"), "earlier")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= t * (F.size("x") + F.size("y") - common) - 1e-9).select("later").distinct()


def preceded(docs: DataFrame, lines: DataFrame, rank: np.ndarray, back: np.ndarray, id_col: str, text_col: str, t: float, wide: bool = True) -> DataFrame:
    """``key1`` of all line sets to which a set that occurs first before them is similar; ``lines`` says where sets occur.

    One similar set is enough, so each set first tries the few candidates that differ least by their
    bitmaps; a crowd of near copies costs a few pairs a line.  Sets that none of those confirms and that
    have more candidates then try all of these, at the words where they have them.
    """
    scratch = Scratch(docs.sparkSession)
    postings = _postings(docs, id_col, text_col, rank, back, t, wide)
    pairs = scratch.write(_candidates(postings, t))
    real = pairs.where("later <> earlier")
    sets = _sets_of(docs, lines, real, id_col, text_col)
    # The closest candidate of each line settles nearly all, so the others' sets need not be joined to it.
    closest = real.groupBy("later").agg(F.min(F.struct("differ", "earlier")).alias("c")).select("later", "c.earlier")
    found = scratch.write(_verified(closest, sets, t))
    found = scratch.write(found.unionByName(_verified(real.join(found, "later", "left_anti"), sets, t)))
    open_ = pairs.where("later = earlier").select("later", "word").join(found, "later", "left_anti")
    if not open_.isEmpty():
        open_ = scratch.write(open_)
        words = _marked(open_.select(F.col("word").alias("key1")))
        rest = _candidates(_postings(docs, id_col, text_col, rank, back, t, wide, words), t, _marked(open_.select(F.col("later").alias("key1"))))
        rest = scratch.write(rest.join(open_.select("later").distinct(), "later", "left_semi").where("later <> earlier"))
        found = found.unionByName(_verified(rest, _sets_of(docs, lines, rest, id_col, text_col), t)).distinct()
    return found.withColumnRenamed("later", "key1")


def later_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``id`` and ``removed``, the line numbers (from 0) to remove, of the documents that lose a line.

    A line is the text between line feeds, its set the different words between ASCII blanks with A-Z
    lower-cased.  A line goes when an earlier line, by document id and line number, has a set with a
    Jaccard similarity of ``similarity`` or more; whether that one goes itself does not matter.  Lines of
    few words, as in scripts without blanks, go as exact copies; blank lines stay.

    Ids that aren't integers are numbered in their order first, and the numbers stand for them.

    Equal sets are merged first.  Each different set posts its rarest words, as many as the prefix
    filter needs; sets that meet at a word pass the length and position filters and a bitmap bound on
    the symmetric difference, and the Jaccard similarity of the rest is computed from their whole sets.
    Words are 44-bit codes; copies are grouped by 128-bit keys and pairs named by the first 64 of these bits, so
    equality is as sure as those hashes.

    Null and empty texts lose nothing; repeated rows of one id are one document; a null id comes first.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity must be from 0.5 to 1")
    scratch = Scratch(docs.sparkSession)
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        ids = numbered(scratch, docs.select(F.col(id_col).alias("id")).distinct(), ["id"])
        texts = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"))
        gone = later_matches(texts.join(ids, texts["own"].eqNullSafe(ids["id"])).select("place", "text"), "place", "text", similarity)
        return gone.withColumnRenamed("id", "place").join(ids, "place").select("id", "removed")
    found = scratch.write(_occurrences(docs, id_col, text_col))
    rank, back = _ranks(found)
    lines = found.where("line >= 0")
    most, low, high = lines.agg(F.max("line"), F.min(_order(F.col("id"))), F.max(_order(F.col("id")))).first()
    wide = (most or 0) > _MOST
    place = F.struct(_order(F.col("id")).alias("ord"), "line", "id")
    if not wide and low is not None and -(1 << 43) <= low <= high < 1 << 43:  # one long, whose minimum needs no sort
        place = F.shiftleft(F.col("id").cast("long"), 20) + F.col("line")
    sets = lines.groupBy("key1", "key2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("times"))
    # Merged at any size: a broadcast would serve small inputs only.
    late = preceded(docs, lines, rank, back, id_col, text_col, similarity, wide).withColumn("late", F.lit(True)).hint("merge")
    goers = sets.join(late, "key1", "left").where("times > 1 or late").select("key1", "key2", "at", "late")
    gone = lines.join(goers.hint("merge"), ["key1", "key2"]).where(F.col("late") | (place > F.col("at")))
    return gone.groupBy("id").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents without their later lines, with all columns; documents of nothing else go.

    A document whose every non-blank line was removed is dropped; one that was blank before stays.
    """
    free = (f"gone_{k}" for k in range(len(docs.columns) + 2) if f"gone_{k}" not in docs.columns)
    own, removed = next(free), next(free)
    gone = later_matches(docs, id_col, text_col, similarity).select(F.col("id").alias(own), F.col("removed").alias(removed))
    met = docs.join(gone, docs[id_col].eqNullSafe(gone[own]), "left")
    left = F.filter(F.split(F.col(text_col), "\n"), lambda line, k: ~F.array_contains(removed, k))
    text = F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    met = met.withColumn(text_col, text)
    return met.where(F.col(removed).isNull() | (F.trim(F.regexp_replace(F.col(text_col), r"[\x09-\x0D]", " ")) != "")).select(docs.columns)
