"""Alignment of two tokenizers over the same texts, by divide and conquer at the byte offsets where both end a token.

A text's tokens are two rising lists of byte offsets.  An interval of them is cut at a common end near its middle, which
is located by bisection, and both halves are cut likewise; an interval without a common end is a leaf, a group.  The ends
of many texts are cut at once: their offsets stand one text behind another, and each round halves all open intervals.

The two tokens that end at a common offset are linked, and one of the two is a suffix of the other.  So the pairs of ids
that can ever be linked are bounded by the vocabularies, whatever the corpus: their counts are a table of proven size.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import Scratch

#: Where the vocabulary files are, on the driver and all executors.
FOLDER = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair of ids is one number: A's times this, plus B's.
_PAIR = 1 << 20
#: Texts are encoded together up to so many bytes.
_TOGETHER = 1 << 20
#: A level of probes looks at so many ends on each side of an interval's middle.
_NEAR = 4


# How A's tokenizer cuts a text into words before it merges bytes.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts of these characters alone are cut by ``_WORD``: what they are is the same in all versions of Unicode.
_SETTLED = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u205e]*")
#: Words whose ids a worker remembers at most.
_REMEMBERED = 500_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 characters are themselves, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Coder:
    """Both tokenizers, and the bytes of each of their entries."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(os.path.join(folder, BYTE_FILE))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECE_FILE))
        alphabet = _byte_alphabet()
        self.a_bytes = [bytes(alphabet[c] for c in self.a.id_to_token(k)) for k in range(self.a.get_vocab_size())]
        self.b_bytes = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode())
        if not all(self.a_bytes) or not all(self.b_bytes):
            raise ValueError("an entry without bytes could end where another does")
        self.words: dict[str, list[int]] = {}
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        #: What stands for a token among the groups: its number and the mark behind it, A's first.
        self.entries = [b"%d%c" % (k, mark) for known, marks in ((self.a_bytes, b",|"), (self.b_bytes, b",;")) for mark in marks for k in range(len(known))]

    def linkable(self) -> int:
        """How many pairs of an A and a B entry there are of which one is a suffix of the other."""
        of_a, of_b = {}, {}
        for known, entries in ((of_a, self.a_bytes), (of_b, self.b_bytes)):
            for e in entries:
                known[e] = known.get(e, 0) + 1
        shorter = sum(of_b.get(e[j:], 0) * n for e, n in of_a.items() for j in range(len(e)))
        return shorter + sum(of_a.get(e[j:], 0) * n for e, n in of_b.items() for j in range(1, len(e)))

    def encode_bytes(self, texts: list[str]) -> list[list[int]]:
        """A's ids.  A word's are the same wherever it stands, so each is encoded once and remembered; texts with other characters go to the tokenizer whole."""
        out: list = [None] * len(texts)
        words = {k: _WORD.findall(t) for k, t in enumerate(texts) if _SETTLED.fullmatch(t)}
        new = list(set(chain.from_iterable(words.values())).difference(self.words))
        if len(self.words) + len(new) > _REMEMBERED:
            self.words.clear()
            new = list(set(chain.from_iterable(words.values())))
        self.words.update(zip(new, (e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False))))
        for k, found in words.items():
            out[k] = list(chain.from_iterable(map(self.words.__getitem__, found)))
        rest = [k for k in range(len(texts)) if k not in words]
        for k, e in zip(rest, self.a.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of both for each text; nothing for an empty one or where the bytes of one differ from the spaced text."""
        spaced = [" " + t for t in texts]
        a = self.encode_bytes(spaced)
        b = self.b.encode(texts, num_threads=1)
        out = []
        for text, t, x, y in zip(texts, spaced, a, b):
            same = text and b"".join(map(self.a_bytes.__getitem__, x)) == (want := t.encode()) and b"".join(map(self.b_bytes.__getitem__, y)) == want
            out.append((x, y) if same else ([], []))
        return out


@lru_cache(1)
def coder(folder: str) -> Coder:
    """Loaded once for each Python worker."""
    return Coder(folder)


def common_ends(left: np.ndarray, right: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks which of ``left`` stand in ``right`` too, by cutting intervals of ``left`` at common ends near their middles.

    Both rise.  ``first`` has the starts of the intervals to begin with, and the end of the last.  Each round probes the
    middles of all open intervals by bisection, then their neighbours outwards; an interval is cut at the first common end
    that is met, and what was probed beside it is known to hold none.  A round that meets none leaves both sides of what was
    probed open.  Every end is probed once at most, so a list without common ends costs no more than its length.
    """
    found = np.zeros(len(left), bool)
    low, high = first[:-1].astype(np.int64), first[1:].astype(np.int64)
    while True:
        open_ = low < high
        low, high = low[open_], high[open_]
        if not len(low):
            return found
        middle = (low + high) // 2
        cut = np.full(len(low), -1)
        seen_low, seen_high = middle.copy(), middle.copy()
        waits = np.arange(len(low))
        for step in range(2 * _NEAR):
            probe = middle[waits] + ((step + 1) // 2 if step % 2 else -(step // 2))
            fits = (probe >= low[waits]) & (probe < high[waits])
            who, probe = waits[fits], probe[fits]
            at = np.searchsorted(right, left[probe])
            met = (at < len(right)) & (right[np.minimum(at, len(right) - 1)] == left[probe]) if len(right) else np.zeros(len(probe), bool)
            seen_low[who], seen_high[who] = np.minimum(seen_low[who], probe), np.maximum(seen_high[who], probe + 1)
            cut[who[met]] = probe[met]
            found[probe[met]] = True
            waits = waits[cut[waits] < 0]
            if not len(waits):
                break
        low, high = np.stack([low, seen_high], 1).ravel(), np.stack([seen_low, high], 1).ravel()  # in order, so that probes read onwards


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids behind one another, and where each text's begin."""
    first = np.concatenate([[0], np.cumsum(list(map(len, lists)))]).astype(np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(first[-1])), first


def _rows(known: Coder, texts: list[str]) -> Iterator[tuple]:
    """Of each text its counts, the digest of its groups, and its links as pairs with how often each stands there.

    The groups of all texts are written at once: a token's entry is its number with the mark that follows it, a comma, or
    after the last of its side of a group the bar or the semicolon, and a side's tokens go behind all of the groups before.
    """
    ids = known.encode(texts)
    (flat_a, first_a), (flat_b, first_b) = (_flat([pair[k] for pair in ids]) for k in (0, 1))
    ends_a, ends_b = np.cumsum(known.a_sizes[flat_a]), np.cumsum(known.b_sizes[flat_b])
    last_a, last_b = common_ends(ends_a, ends_b, first_a), np.zeros(len(flat_b), bool)
    cut_a = np.flatnonzero(last_a)
    cut_b = np.searchsorted(ends_b, ends_a[cut_a])
    last_b[cut_b] = True
    entries = np.empty(len(flat_a) + len(flat_b), np.int64)
    entries[np.arange(len(flat_a)) + np.concatenate([[0], cut_b + 1])[np.cumsum(last_a) - last_a]] = flat_a + last_a * len(known.a_bytes)
    entries[np.arange(len(flat_b)) + np.append(cut_a + 1, 0)[np.cumsum(last_b) - last_b]] = flat_b + last_b * len(known.b_bytes) + 2 * len(known.a_bytes)
    links, text_of, first = flat_a[cut_a] * _PAIR + flat_b[cut_b], np.searchsorted(cut_a, first_a), first_a + first_b
    for k, (x, y) in enumerate(ids):
        a, b = text_of[k], text_of[k + 1]
        groups = b"".join(map(known.entries.__getitem__, entries[first[k] : first[k + 1]].tolist()))[:-1]
        pairs, times = np.unique(links[a:b], return_counts=True)
        yield len(x), len(y), b - a, b - a, hashlib.sha256(groups).hexdigest() if x else "", pairs, times


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), kind))


_ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _aligner(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(folder)
        for batch in batches:
            sizes = np.cumsum(pa.compute.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _TOGETHER, "right")))
                part = batch.slice(at, to - at)
                rows = list(zip(*_rows(known, [t or "" for t in part["text"].to_pylist()])))
                longs = [pa.array(np.array(c, np.int64)) for c in rows[:4]]
                yield pa.RecordBatch.from_arrays([part["id"], *longs, pa.array(rows[4], pa.string()), _lists(rows[5], pa.int64()), _lists(rows[6], pa.int32())], names=[c.split()[0] for c in _ALIGNED.split(", ")])
                at = to

    return run


def align(docs: DataFrame, folder: str = FOLDER, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each text ``id``, token and group counts, the digest of its groups, and its linked pairs with their ``times``.

    A pair is A's id times 2^20 plus B's.  Null and empty texts, and those that a tokenizer doesn't give back byte by byte
    (as it does with U+2581, or with what it normalises), have no tokens: zeros, an empty digest and no pairs.
    """
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_aligner(folder), _ALIGNED)


def count_links(aligned: DataFrame, folder: str = FOLDER) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs of the corpus and how many links hold each, as two sorted arrays.

    They are as many as the vocabularies have entries that end alike at most, and this bound is checked.
    """
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    bound = coder(folder).linkable()
    found = each.limit(bound + 1).toArrow()
    if found.num_rows > bound:
        raise RuntimeError(f"more than the {bound} pairs of entries that can end together")
    pair, n = (found[c].to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    return pair[order], n[order]


def corpus_sums(aligned: DataFrame, pairs: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Adds ``n_best``, the links whose count is the highest of their B id, and ``count_sum``, the sum of the links' counts."""
    b = pairs % _PAIR
    highest = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, b, counts)
    shared = aligned.sparkSession.sparkContext.broadcast((pairs, counts, counts == highest[b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch["pairs"].offsets)))
            at = np.searchsorted(known, np.asarray(batch["pairs"].flatten()))
            times = np.asarray(batch["times"].flatten()).astype(np.int64)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for total, value in zip(sums, (best[at] * times, n[at] * times) if len(known) else ()):
                np.add.at(total, of, value)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *map(pa.array, sums)], names=[*kept, "n_best", "count_sum"])

    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return aligned.select(*kept, "pairs", "times").mapInArrow(run, "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def align_corpus(docs: DataFrame, folder: str = FOLDER, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document with the counts of its own tokens, groups and links, and of its links in the whole corpus.

    Ids are integers and may be null or repeat: each row counts by itself.  An empty table has no rows; columns that are not
    named are not read.  The aligned texts are written once and read twice; the driver gets the table of counts alone.
    """
    aligned = Scratch(docs.sparkSession).write(align(docs, folder, id, text))
    return corpus_sums(aligned, *count_links(aligned, folder)).withColumnRenamed("id", id)
