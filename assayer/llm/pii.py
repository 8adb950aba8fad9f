"""Personal data: base patterns, and a skip-chain conditional random field that adds spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
K = len(LABELS)
#: Documents (in expectation) and nodes of each that the field is trained on; a hash of the place picks the nodes.
MAX_TRAIN_DOCS = 20_000
MAX_TRAIN_NODES = 100
#: Posterior probability from which a span is added.
CERTAIN = 0.9
#: Messages of a document are passed until none changes by more than SETTLED, or so many times.
ROUNDS, SETTLED = 100, 1e-4
#: Nodes that are further apart than so many characters are not neighbours in the chain.
REACH = 60
#: What the skip weight is before any example: equal keys are one entity with odds of a few thousand to one; and how much that weighs.
CONSISTENT, FIRM = 8.0, 0.01
#: Classes of what stands between neighbours: blanks and signs only, or the last word by a checksum.
GAPS = 9

_HINT = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does: the parts before it take whole runs.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NUMERIC = re.compile(r"[0-9()+.,;:/-]+\Z")
_EDGE = "\"'`()[]{}<>,;:.!?=*|&$%#"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def _is_ip(s: str) -> bool:
    return all(int(p.lstrip("0")[:4] or 0) <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_phone(s: str) -> bool:
    return 9 <= len(_DIGITS.findall(s)) <= 15


_CHECKED = ((1 + KINDS.index("ip"), _IP, _is_ip), (1 + KINDS.index("card"), _CARD, _is_card), (1 + KINDS.index("phone"), _PHONE, _is_phone))


def base_spans(text: str) -> list[Span]:
    """Kind, start and end (code points) of the base patterns, by kind, then by start."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGITS.search(text):
        for label, pattern, check in _CHECKED:
            if label != LABELS.index("phone") or "+" in text:
                out += [(LABELS[label], *m.span()) for m in pattern.finditer(text) if check(m[0])]
    return out


def alone(s: str) -> bool:
    """Whether a text would be a base span if nothing stood beside it."""
    return any(pattern.fullmatch(s) and check(s) for _, pattern, check in _CHECKED)


def span_string(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


@dataclass
class Graph:
    """Nodes of one or more documents with their features; ``label`` is -1 where no base span says it.

    ``gap`` is the class of what stands between the neighbours of each chain link.
    """

    doc: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    gap: list[int] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)


_CUTS = (0, 1, 2, 4, 6, 8, 10, 12, 15, 16, 19)
N_FEATURES = 63


def _features(s: str, before: str) -> list[int]:
    """Indices of the features of a span: shape, check digits and the word before it."""
    digits = "".join(_DIGITS.findall(s))
    n = len(digits)
    out = [0, 1 + next((k for k, c in enumerate(_CUTS) if n <= c), len(_CUTS))]
    dots = min(s.count("."), 4)
    out.append(13 + dots)
    letters = any(c.isalpha() for c in s)
    flags = (
        "@" in s, s.startswith("+"), "(" in s, "-" in s, " " in s, letters, not letters and n > 0, 13 <= n <= 19 and luhn(digits),
        dots == 3 and not letters and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in s.split(".")), "_" in s or "=" in s,
        len(s) > 24, "/" in s, bool(re.search(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\Z", s)), n > 0 and n == len(s), ":" in s, len(s) < 4,
    )
    out += [18 + k for k, f in enumerate(flags) if f]
    out.append(34 + sum(before.lower().encode()[-4:]) % 29)
    return out


def _key(s: str) -> str:
    """Equal for repeated and similar nodes: the same digits however they are grouped, or the same text in any case."""
    digits = "".join(_DIGITS.findall(s))
    return digits if len(digits) >= 7 and "@" not in s else s.lower()


def _gap(between: str) -> int:
    words = re.findall(r"[^\W\d_]+", between)
    return 1 + crc32(words[-1].lower().encode()) % (GAPS - 1) if words else 0


def _segments(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Numeric tokens that follow each other by one blank, cut where a part would be a base span alone.

    Such parts, the longest first at each token, are nodes of their own, as is what lies between two.
    """
    rest = at = 0
    while at < len(tokens):
        ends = (k for k in range(min(len(tokens), at + 8), at, -1) if alone(text[tokens[at][0] : tokens[k - 1][1]]))
        to = next(ends, None)
        if to is None:
            at += 1
            continue
        if rest < at:
            yield tokens[rest][0], tokens[at - 1][1]
        yield tokens[at][0], tokens[to - 1][1]
        rest = at = to
    if rest < len(tokens):
        yield tokens[rest][0], tokens[-1][1]


def add_document(graph: Graph, doc: int, text: str, base: list[Span]) -> None:
    """Adds the nodes of a text: its base spans, and the other tokens with a digit or an at sign.

    Numeric tokens that follow each other by one blank form one node, unless parts of them would be base spans
    alone.  Neighbours are linked in a chain; nodes with equal keys are all linked to one of them, the first base
    span or else the first node, so that what is known of one is two links from each other, however far.
    """
    nodes: list[tuple[int, int, int]] = []
    reach = 0
    for a, b, label in sorted((a, b, LABELS.index(k)) for k, a, b in base):
        if a >= reach:
            nodes.append((a, b, label))
            reach = b
    inside = iter([*nodes, (len(text) + 1, len(text) + 1, 0)])
    low, high, _ = next(inside)
    run: list[tuple[int, int]] = []

    def close() -> None:
        nodes.extend((a, b, -1) for a, b in _segments(text, run))
        run.clear()

    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while high <= a:
            low, high, _ = next(inside)
        if b > low or not _HINT.search(text, a, b):
            continue
        while a < b and text[a] in _EDGE and text[a] != "(":
            a += 1
        while b > a and text[b - 1] in _EDGE and text[b - 1] != ")":
            b -= 1
        if a >= b:
            continue
        numeric = bool(_NUMERIC.match(text, a, b))
        if run and not (numeric and run[-1][1] + 1 == a and text[a - 1] == " "):
            close()
        if numeric:
            run.append((a, b))
        else:
            nodes.append((a, b, -1))
    close()
    nodes.sort()
    hubs: dict[str, int] = {}
    keys = []
    first = len(graph.doc)
    for here, (a, b, label) in enumerate(nodes, first):
        s = text[a:b]
        prior = text[max(0, a - 24) : a].split()
        graph.doc.append(doc)
        graph.start.append(a)
        graph.end.append(b)
        graph.label.append(label)
        graph.features.append(_features(s, prior[-1] if prior else ""))
        if here > first and a - graph.end[here - 1] <= REACH:
            graph.chain.append((here - 1, here))
            graph.gap.append(_gap(text[graph.end[here - 1] : a]))
        keys.append(_key(s))
        if keys[-1] not in hubs or (label >= 0 > graph.label[hubs[keys[-1]]]):
            hubs[keys[-1]] = here
    graph.skip += [(hubs[key], here) for here, key in enumerate(keys, first) if hubs[key] != here]


@dataclass
class Field:
    """Weights of the node features, of chain neighbours (by the class of their gap, or the same for all) and of skip links that agree."""

    unary: np.ndarray
    chain: np.ndarray
    skip: float


def _matrix(bits: np.ndarray) -> np.ndarray:
    return ((bits[:, None] >> np.arange(N_FEATURES)) & 1).astype(np.float32)


def _sides(label: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """A column for each label and gap of a neighbour; none for -1."""
    out = np.zeros((len(label), GAPS * K), np.float32)
    seen = np.flatnonzero(label >= 0)
    out[seen, gap[seen] * K + label[seen]] = 1
    return out


def fit(
    x: np.ndarray, y: np.ndarray, before: np.ndarray, before_gap: np.ndarray, after: np.ndarray, after_gap: np.ndarray, linked: np.ndarray, times: np.ndarray,
    rounds: int = 300, rate: float = 0.1, decay: float = 1e-4,
) -> Field:
    """Maximum pseudo-likelihood of all weights together: the label of each node given its features and the labels of its
    neighbours and of what a skip link ties it to (-1: hidden or none).

    ``times`` says how often each row was seen.  The skip weight is the same for all labels and starts from ``CONSISTENT``, since
    links to what no pattern says have no examples.
    """
    if not len(y):
        return Field(np.zeros((N_FEATURES, K)), np.zeros((GAPS, K, K)), CONSISTENT)
    want = np.eye(K, dtype=np.float32)[y]
    share = (times / times.sum()).astype(np.float32)[:, None]
    design = np.concatenate([x, _sides(before, before_gap), _sides(after, after_gap)], 1)
    tie = np.where((linked >= 0)[:, None], np.eye(K, dtype=np.float32)[np.maximum(linked, 0)], 0)
    # The last row is the skip weight, in its first column.
    weights = np.zeros((design.shape[1] + 1, K), np.float32)
    weights[-1, 0] = CONSISTENT
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        z = design @ weights[:-1] + weights[-1, 0] * tie
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        off = (p - want) * share
        grad = decay * weights
        grad[:-1] += design.T @ off
        grad[-1, 0] = FIRM * (weights[-1, 0] - CONSISTENT) + (off * tie).sum()
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        weights -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    back, on = (w.reshape(GAPS, K, K).astype(np.float64) for w in (weights[N_FEATURES : N_FEATURES + GAPS * K], weights[N_FEATURES + GAPS * K : -1]))
    return Field(weights[:N_FEATURES].astype(np.float64), (back + on.transpose(0, 2, 1)) / 2, max(0.0, float(weights[-1, 0])))


def _soft(x: np.ndarray) -> np.ndarray:
    top = x.max(1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(1, keepdims=True))


def beliefs(graph: Graph, model: Field, rounds: int = ROUNDS) -> np.ndarray:
    """Log-beliefs of all nodes after damped loopy message passing along the chain and skip links.

    Each document stops by its own messages, so none depends on which others are passed beside it.
    """
    sizes = [len(f) for f in graph.features]
    unary = np.add.reduceat(model.unary[np.concatenate([np.array(f, np.int64) for f in graph.features])], np.cumsum(sizes) - sizes, axis=0)
    known = np.flatnonzero(np.array(graph.label) >= 0)
    unary[known] = -50
    unary[known, np.array(graph.label)[known]] = 0
    chain, skip = np.array(graph.chain, np.int64).reshape(-1, 2), np.array(graph.skip, np.int64).reshape(-1, 2)
    source = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
    target = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
    n, c, s = len(unary), len(chain), len(skip)
    if not len(source):
        return _soft(unary)
    back = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(s) + 2 * c + s, np.arange(s) + 2 * c])
    same = np.eye(K) * model.skip
    gap = np.array(graph.gap or [0] * c, np.int64)
    near = np.broadcast_to(model.chain, (GAPS, K, K))[gap]
    pair = np.concatenate([near, near.transpose(0, 2, 1), *[np.broadcast_to(same, (s, K, K))] * 2])
    doc = np.unique(np.array(graph.doc), return_inverse=True)[1][source]
    message = np.zeros((len(source), K))
    open_ = np.arange(len(source))
    for _ in range(rounds):
        total = unary.copy()
        for k in range(K):
            total[:, k] += np.bincount(target, message[:, k], n)
        out = (total[source[open_]] - message[back[open_]])[:, :, None] + pair[open_]
        top = out.max(1)
        new = _soft(top + np.log(np.exp(out - top[:, None, :]).sum(1)))
        step = np.zeros(int(doc.max()) + 1)
        np.maximum.at(step, doc[open_], np.abs(new - message[open_]).max(1))
        message[open_] = 0.5 * message[open_] + 0.5 * new
        open_ = open_[step[doc[open_]] > SETTLED]
        if not len(open_):
            break
    for k in range(K):
        unary[:, k] += np.bincount(target, message[:, k], n)
    return _soft(unary)


def _examples(doc: str, text: str) -> Iterator[tuple[int, ...]]:
    """Feature bits, label, and label and gap of either neighbour and the label at a skip link, of the nodes that train the field.

    Nodes that would be base spans alone, and those that a skip link ties to one, are examples of nothing: what they
    are is for the field to say.  Of what a node's neighbours and link say a checksum hides half, as it is hidden where no
    pattern says it, and it hides the features of half of the nodes whose link is seen and of a quarter of the others, so that
    shape, neighbours and links each learn to do without the others.
    """
    g = Graph()
    add_document(g, 0, text, base_spans(text))
    tied = {b for a, b in g.skip if g.label[a] >= 0} | {a for a, b in g.skip if g.label[b] >= 0}
    open_ = {k for k in range(len(g.doc)) if g.label[k] < 0 and (k in tied or alone(text[g.start[k] : g.end[k]]))}
    label = [max(k, 0) for k in g.label]
    mark = [crc32(f"{doc} {k}".encode()) for k in g.start]
    gap = dict(zip(g.chain, g.gap))
    before, after = {b: a for a, b in g.chain}, {a: b for a, b in g.chain}
    link = {a: b for a, b in g.skip} | {b: a for a, b in g.skip}
    use = sorted((k for k in range(len(label)) if k not in open_), key=mark.__getitem__)[:MAX_TRAIN_NODES]

    def seen(k: int, other: int | None, bit: int) -> int:
        return -1 if other is None or other in open_ or mark[k] >> bit & 1 else label[other]

    for k in use:
        a, b, tie = before.get(k), after.get(k), seen(k, link.get(k), 2)
        bits = 1 if mark[k] >> 3 & (1 if tie >= 0 else 3) == 1 else sum(1 << f for f in g.features[k])
        yield bits, label[k], seen(k, a, 0), gap.get((a, k), 0), seen(k, b, 1), gap.get((k, b), 0), tie


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_TRAIN_DOCS) -> Field:
    """Fits the field on about ``max_docs`` documents that a hash of id and text picks.

    Base spans are the examples of each kind and the other nodes those of none (see ``_examples``).  Equal
    examples are counted before they reach the driver, which gets ``max_docs`` times ``MAX_TRAIN_NODES`` of them at most;
    repeated rows only raise a count.
    """
    n = docs.count()
    some = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    if n > max_docs:
        some = some.where(F.pmod(F.xxhash64(F.lit("pii"), "id", "text"), F.lit(1 << 30)) < int(max_docs / n * (1 << 30)))
    names = ["bits", "label", "before", "before_gap", "after", "after_gap", "linked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in _examples(doc or "", text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(7)], names)

    counted = some.mapInArrow(run, ", ".join(f"{n} long" for n in names)).groupBy(*names).agg(F.count(F.lit(1)).alias("times"))
    rows = np.array(sorted(map(tuple, counted.toLocalIterator())), np.int64).reshape(-1, 8)
    return fit(_matrix(rows[:, 0]), *rows[:, 1:].T)


def find(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``base`` and ``spans`` (arrays of kind, start and end in code points).

    ``spans`` holds the base spans and those that the field adds: nodes whose posterior for a kind is
    ``CERTAIN`` or more.  Null and empty texts have none; repeated rows each keep a row.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base: list[list[Span]] = []
            graph = Graph()
            added: dict[int, list[Span]] = {}

            def settle(graph: Graph, added: dict = added) -> None:
                if not graph.doc or min(graph.label) >= 0:
                    return
                belief = np.exp(beliefs(graph, model))
                best = belief[:, 1:].argmax(1) + 1
                for k in np.flatnonzero((np.array(graph.label) < 0) & (belief.max(1) >= CERTAIN) & (belief.argmax(1) > 0)):
                    added.setdefault(graph.doc[k], []).append((LABELS[best[k]], graph.start[k], graph.end[k]))

            for doc, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                if not _HINT.search(text):
                    base.append([])
                    continue
                base.append(base_spans(text))
                add_document(graph, doc, text, base[-1])
                if len(graph.doc) > 20_000:
                    settle(graph)
                    graph = Graph()
            settle(graph)
            every = [b + added.get(k, []) for k, b in enumerate(base)]
            cells = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in x], span) for x in (base, every)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], ["id", "base", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    one = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"id {kind}, base {one}, spans {one}").withColumnRenamed("id", id_col)


def joined(spans: str):
    """kind:start:end of a span column, by kind as in KINDS, then by start, comma-joined."""
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"], s["kind"]))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
