"""A hashed maximum-entropy language model with a class-factored softmax.

``P(word | history) = P(class | history) * P(word | class, history)``. Classes 0-15 hold 32 frequent words each, by rank;
within them the word is a second softmax. Classes 16-31 take all other words by their last letters; within them words
follow their smoothed counts, with room for one unknown word. The features of a history are its last word, the one
before it (skip), both (bigram history) and the classes of the last three words, each hashed into rows of weights.

Training is distributed: in each round every task takes the current weights, runs steps of gradient descent (AdaGrad per row of weights) over its documents in
sparse numpy batches and returns what it changed; changes are averaged by how often a row was touched, and enlarged by
a power of the number of tasks that saw the row, chosen by likelihood. All training documents are used once. Counts of all words are gathered by a shuffle; the frequent ones, of bounded number, are
broadcast, and the rest of a document's words meets its counts in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from millrace.llm.shared import returning, slices, small_batches, stored

WIDTH = 32                      # classes, and words of a class with a softmax of its own
SOFT, SHAPES = 16, 16           # classes of frequent words, classes by shape
HEAD = 1 << 17                  # frequent words that are broadcast, at most
ROWS = (1 << 13, 1 << 13, 1 << 14, 1 << 14)   # weight rows of each class feature
INNER = (1 << 13, 1 << 13)      # weight rows of each feature within a class
assert max(sum(ROWS), sum(INNER)) <= 1 << 16 and not any(n & n - 1 for n in (*ROWS, *INNER))
BATCH = 16_384
FIRST = 512                     # tokens of a task's first step
RATE = 0.4
FEW = 32                        # a weight row's tokens in a step up to which they are added for all rows at once
TEXTS = 1 << 22                 # bytes of text that are split at once
TAIL = 1 << 20
END = b""                       # a word is never empty, so the empty word is the end
DELTA = 0.1
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)   # of a row's spread over tasks, tried after each round
SHARES = (0.1, 0.88, 0.02)      # of the training documents in each round


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words between white space ([ \\t-\\r]), A-Z lower-cased, and the end of each text, as one array; how many each text has."""
    bare = pc.ascii_lower(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.string()), "")))
    ended = pc.if_else(pc.equal(bare, ""), "", pc.binary_join_element_wise(bare, "", " "))   # what follows the last space is empty: the end
    found = pc.ascii_split_whitespace(ended)
    return found.flatten().cast(pa.binary()), np.asarray(pc.list_value_length(found), np.int64)


def shape(word: bytes) -> int:
    return SOFT + zlib.crc32(word[-3:]) % SHAPES


def shapes(words: pa.Array) -> np.ndarray:
    """``shape`` of each word; it is worked out once per ending."""
    ends = pc.binary_slice(words, -3).dictionary_encode()
    return np.fromiter(map(shape, _bytes(ends.dictionary)), np.int64, len(ends.dictionary))[np.asarray(ends.indices)]


def _bytes(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()   # several times as fast as to_pylist()


@dataclass
class Vocabulary:
    """Counts of the training tokens: in all, by class of other words, and of the frequent words (most frequent first)."""
    total: int
    distinct: int
    head: list[bytes]
    counts: np.ndarray
    class_total: np.ndarray
    class_distinct: np.ndarray

    def __post_init__(self):
        soft = min(len(self.head), SOFT * WIDTH)
        self.classes = np.array([r // WIDTH if r < soft else shape(w) for r, w in enumerate(self.head)], np.int64)
        self.base = self.total + DELTA * (self.distinct + 1)
        self.room = self.class_total + DELTA * (self.class_distinct + 1)   # of the classes by shape
        mass = np.zeros(WIDTH)
        np.add.at(mass, self.classes[:soft], self.counts[:soft].astype(float))
        mass += self.room
        mass[:SOFT] = np.where(np.bincount(self.classes[:soft], minlength=WIDTH)[:SOFT] > 0, mass[:SOFT], 0)
        with np.errstate(divide="ignore"):
            self.class_bias = np.log(mass / mass.sum()).astype(np.float32)         # a class without words gets none
        self.word_bias = np.full((SOFT, WIDTH), -np.inf, np.float32)
        for r in range(soft):
            self.word_bias[r // WIDTH, r % WIDTH] = np.log(max(self.counts[r], DELTA))


class Codes:
    """Word to code: the rank of a frequent word, else ``HEAD`` + class and hash."""

    def __init__(self, head: list[bytes]):
        self.head = pa.array(head, pa.binary())

    def __getitem__(self, word: bytes) -> int:
        return int(self.of(pa.array([word], pa.binary()))[0])

    def of(self, words: pa.Array) -> np.ndarray:
        codes = np.array(pc.fill_null(pc.index_in(words, self.head), -1), np.int64)
        if len(rare := np.flatnonzero(codes < 0)):
            others = words.take(pa.array(rare))
            hashes = np.fromiter(map(zlib.crc32, _bytes(others)), np.int64, len(rare))
            codes[rare] = HEAD + shapes(others) * TAIL + hashes % TAIL
        return codes


class Weights:
    """Rows of weights of both softmaxes and, per row, the sum of its squared gradients, which sets its step."""

    def __init__(self, outer: np.ndarray | None = None, inner: np.ndarray | None = None, outer2: np.ndarray | None = None, inner2: np.ndarray | None = None):
        self.outer = np.zeros((sum(ROWS), WIDTH), np.float32) if outer is None else outer
        self.inner = np.zeros((sum(INNER), WIDTH), np.float32) if inner is None else inner
        self.outer2 = np.zeros(sum(ROWS)) if outer2 is None else outer2
        self.inner2 = np.zeros(sum(INNER)) if inner2 is None else inner2


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h ^= p.view(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h >>= np.uint64(20)
    return h


def _rows(at: int, rows: int, *parts: np.ndarray) -> np.ndarray:
    """Of ``rows`` rows, a power of two, from ``at`` on the one that ``parts`` are hashed into."""
    h = _mix(*parts)
    h &= np.uint64(rows - 1)
    h += np.uint64(at)
    return h.view(np.int64)


class Stream:
    """Codes, classes and features of the tokens of some documents."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary):
        self.codes = codes
        self.head = codes < HEAD
        others = np.flatnonzero(~self.head)
        self.cls = np.take(vocabulary.classes, codes, mode="clip") if len(vocabulary.classes) else np.zeros(len(codes), np.int64)
        self.cls[others] = (codes[others] - HEAD) // TAIL
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

        def back(values, k, missing):
            out = np.concatenate([np.full(min(k, len(values)), missing), values[:-k]])
            return np.where(place >= k, out, missing)

        one, two = back(codes, 1, -1), back(codes, 2, -1)
        kinds = [back(self.cls, k, WIDTH) for k in (1, 2, 3)]
        at, self.outer = 0, []
        for parts, rows in zip(((one,), (two,), (one, two), kinds), ROWS):
            self.outer.append(_rows(at, rows, *parts))
            at += rows
        self.soft = np.flatnonzero(self.cls < SOFT)              # tokens whose class has a softmax
        own, at, self.inner = self.cls[self.soft], 0, []
        for p, rows in zip((one, two), INNER):
            self.inner.append(_rows(at, rows, own, p[self.soft]))
            at += rows
        self.slot = self.codes[self.soft] % WIDTH


def _logits(weights: np.ndarray, features: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    z = np.take(weights, features[0], axis=0)
    z += bias
    for f in features[1:]:
        z += np.take(weights, f, axis=0)
    return z


def _widest(z: np.ndarray) -> np.ndarray:
    """The largest of each row, as a column; the width is a power of two, so halves are compared as wholes."""
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        z = np.maximum(z[:, :half], z[:, half:])
    return z


def _step(weights: np.ndarray, squares: np.ndarray, touched: np.ndarray, features: list[np.ndarray], target: np.ndarray, bias: np.ndarray) -> None:
    """One step on the log likelihood of ``target``."""
    z = _logits(weights, features, bias)
    z -= _widest(z)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    z[np.arange(len(z)), target] -= 1
    z = z.astype(np.float64)
    for f in features:
        rows, often, g = _row_sums(z, f)
        squares[rows] += np.einsum("ij,ij->i", g, g)
        touched[rows] += often
        g *= (RATE / (np.sqrt(squares[rows]) + 1e-6)).astype(np.float32)[:, None]
        weights[rows] -= g


def _row_sums(z: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers in ``f``, how often each is there, and the sums of their lines of ``z``, each added in the order of ``z``.

    The most frequent come first, so the numbers that have a k-th line are a run, and one sum adds it for all of them."""
    often = np.bincount(f)
    rows = np.flatnonzero(often)
    rows = rows[np.argsort((FEW + 1 - np.minimum(often[rows], FEW + 1)).astype(np.uint8), kind="stable")]
    lines, begin = np.argsort(f.astype(np.uint16), kind="stable"), (np.cumsum(often) - often)[rows]   # 16 bits: sorted by counting
    often = often[rows]
    least = len(rows) - np.cumsum(np.bincount(np.minimum(often, FEW + 1), minlength=FEW + 2))          # numbers with more than k lines
    out, many = np.take(z, lines[begin], axis=0), least[FEW]
    for k in range(1, FEW):
        if least[k] == many:
            break
        out[many:least[k]] += np.take(z, lines[begin[many:least[k]] + k], axis=0)
    for r in range(many):
        np.add.reduce(np.take(z, lines[begin[r]:begin[r] + often[r]], axis=0), axis=0, out=out[r])
    return rows, often, out.astype(np.float32)


def _cuts(n: int, steps: int) -> Iterator[tuple[slice, int]]:
    """Slices of ``n`` tokens; the first ``steps`` of a task grow from FIRST tokens to BATCH, so that a small share also takes several steps."""
    at = 0
    while at < n:
        size = min(BATCH, FIRST << min(steps, 30))
        yield slice(at, at + size), (steps := steps + 1)
        at += size


def train_batch(w: Weights, state: dict, s: Stream, v: Vocabulary) -> None:
    for cut, state["outer_steps"] in _cuts(len(s.codes), state.get("outer_steps", 0)):
        _step(w.outer, w.outer2, state["outer_n"], [f[cut] for f in s.outer], s.cls[cut], v.class_bias)
    for cut, state["inner_steps"] in _cuts(len(s.soft), state.get("inner_steps", 0)):
        _step(w.inner, w.inner2, state["inner_n"], [f[cut] for f in s.inner], s.slot[cut], v.word_bias[s.cls[s.soft[cut]]])


def _log_shares(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax at ``target``; ``z`` is used up."""
    top, own = _widest(z), z[np.arange(len(z)), target]
    z -= top
    np.exp(z, out=z)
    return own - top[:, 0] - np.log(z.sum(1))


def log10_parts(w: Weights, s: Stream, v: Vocabulary) -> np.ndarray:
    """Per token, log10 of all but the counts of words that are not broadcast."""
    out = np.zeros(len(s.codes))
    for at in range(0, len(s.codes), BATCH):
        cut = slice(at, at + BATCH)
        out[cut] = _log_shares(_logits(w.outer, [f[cut] for f in s.outer], v.class_bias), s.cls[cut])
    for at in range(0, len(s.soft), BATCH):
        cut = slice(at, at + BATCH)
        out[s.soft[cut]] += _log_shares(_logits(w.inner, [f[cut] for f in s.inner], v.word_bias[s.cls[s.soft[cut]]]), s.slot[cut])
    counted = np.flatnonzero(s.head & (s.cls >= SOFT))
    out[counted] += np.log((v.counts[s.codes[counted]] + DELTA) / v.room[s.cls[counted]])
    return out / np.log(10)


# --- Spark jobs --------------------------------------------------------------------------------------------------

def held_out(key: Column, fold: int = 10) -> Column:
    """Whether crc32 of the key as text leaves no remainder; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % fold == 0


def word_counts(training: DataFrame, text: str) -> DataFrame:
    """(word, cls, n) of all training tokens; ``cls`` is the word's class by shape."""
    def count(batches):
        for batch in _texts(batches, text, 2 * TEXTS):
            seen = words_of(batch.column(0))[0].value_counts()
            words = seen.field("values")
            yield pa.RecordBatch.from_arrays([words, pa.array(shapes(words), pa.int32()), seen.field("counts")], names=["word", "cls", "n"])

    return training.select(text).mapInArrow(returning(count), "word binary, cls int, n long").groupBy("word", "cls").agg(F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """Totals and the frequent words: all with at least the count from which on there are no more than ``head`` of them."""
    step = F.floor(F.log2("n") * 16).alias("step")
    sizes = counts.groupBy(step).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()   # 16 rows per doubling
    room, bound = head, None
    for r in sizes:
        if (room := room - r.k) < 0:
            break
        bound = r.least
    rows = counts.filter(F.col("n") >= bound).collect() if bound is not None else []
    rows.sort(key=lambda r: (-r.n, bytes(r.word)))
    soft = {bytes(r.word) for r in rows[:SOFT * WIDTH]}
    totals = np.zeros(WIDTH), np.zeros(WIDTH)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():   # one row per class
        totals[0][r.cls], totals[1][r.cls] = r.n, r.k
    n, k = int(totals[0].sum()), int(totals[1].sum())
    for r in rows[:len(soft)]:
        totals[0][r.cls] -= r.n
        totals[1][r.cls] -= 1
    return Vocabulary(n, k, [bytes(r.word) for r in rows], np.array([r.n for r in rows], np.int64), *totals)


def _texts(batches: Iterable[pa.RecordBatch], text: str, most: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """The batches, small ones joined and large ones cut, with about ``most`` bytes: looking words up costs the same for few of them."""
    def joined():
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= most // 2:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, size = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    return slices(joined(), text, most)


def _streams(batches: Iterable[pa.RecordBatch], codes: Codes, v: Vocabulary, tokens: int = 200_000) -> Iterator[tuple[pa.Array, np.ndarray, Stream]]:
    """Documents in groups of about ``tokens`` tokens: words, sizes, stream."""
    parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []   # of the next group: words, their codes, sizes of documents
    size = 0

    def group():
        words, flat, sizes = zip(*parts)
        parts.clear()
        return pa.concat_arrays(words), (sizes := np.concatenate(sizes)), Stream(np.concatenate(flat), sizes, v)

    for batch in _texts(batches, "_text"):
        words, sizes = words_of(batch.column("_text"))
        flat, ends = codes.of(words), np.cumsum(sizes)
        at = row = 0
        while (last := int(np.searchsorted(ends, at + tokens - size))) < len(ends):   # the document that fills the group
            end = int(ends[last])
            parts.append((words[at:end], flat[at:end], sizes[row:last + 1]))
            yield group()
            at, row, size = end, last + 1, 0
        if row < len(sizes):
            parts.append((words[at:], flat[at:], sizes[row:]))
            size += len(flat) - at
    if parts:
        yield group()


def merged(start: Weights, change: Weights, spread: dict[str, np.ndarray], power: float) -> Weights:
    """The weights after a round: a row moves by the tasks' mean change times its spread to ``power``; squares add up."""
    return Weights(*(getattr(start, name) + getattr(change, name) * (spread[name] ** power)[:, None] for name in ("outer", "inner")),
                   start.outer2 + change.outer2, start.inner2 + change.inner2)


def best_power(sample: DataFrame, v, start: Weights, change: Weights, spread: dict[str, np.ndarray]) -> float:
    """The power of ``POWERS`` under which the documents of ``sample`` are most likely; the smallest of equal ones."""
    shared = sample.sparkSession.sparkContext.broadcast((start, change, spread))

    def measure(batches):
        tried, codes, sums = [merged(*shared.value, power) for power in POWERS], Codes(v.value.head), np.zeros(len(POWERS))
        for _, _, stream in _streams(batches, codes, v.value):
            sums += [log10_parts(w, stream, v.value).sum() for w in tried]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names=[f"p{i}" for i in range(len(POWERS))])

    row = sample.mapInArrow(returning(measure), ", ".join(f"p{i} double" for i in range(len(POWERS)))).agg(*[F.sum(f"p{i}") for i in range(len(POWERS))]).first()
    shared.unpersist()
    return POWERS[int(np.argmax([x or 0.0 for x in row]))]


def train(training: DataFrame, v: Vocabulary, shares: tuple[float, ...] = SHARES, block: int = 512) -> Weights:
    """Rounds over disjoint hash shares of the training documents (column ``_text``), which together are all of them.

    A task's changes travel as blocks of weight rows; the averages that reach the driver are the size of the model.
    All tasks of a round start from the same weights, so the mean of their changes teaches what one task's share does,
    and their sum is too much where each came close to the best by itself. Between the two lies the mean times a power
    of the row's spread, the number of tasks it was seen in (all its touches by the most of one task). The power is
    chosen by the likelihood of the last share, which no round before has learnt from; it is learnt itself in the last
    round, by the mean alone. The squares of all tasks add up and are carried on, so later steps are smaller.
    """
    weights, sc, done = Weights(), training.sparkSession.sparkContext, 0.0
    part = F.pmod(F.xxhash64("_text"), F.lit(1_000_000)) / 1_000_000.0
    total, vocabulary = sum(shares), sc.broadcast(v)
    last = training.filter(part >= (total - shares[-1]) / total).select("_text")
    for share in shares:
        shared = sc.broadcast(weights)

        def learn(batches, shared=shared):
            start, v = shared.value, vocabulary.value
            w = Weights(start.outer.copy(), start.inner.copy(), start.outer2.copy(), start.inner2.copy())
            state = {"outer_n": np.zeros(len(w.outer), np.int64), "inner_n": np.zeros(len(w.inner), np.int64)}
            codes = Codes(v.head)
            for _, _, stream in _streams(batches, codes, v):
                train_batch(w, state, stream, v)
            for name in ("outer", "inner"):
                new, old, n, squares = getattr(w, name), getattr(start, name), state[f"{name}_n"], getattr(w, f"{name}2") - getattr(start, f"{name}2")
                for at in range(0, len(new), block):
                    m = n[at:at + block].astype(np.float32)
                    if m.any():
                        yield pa.RecordBatch.from_pydict({"name": [name], "at": pa.array([at], pa.int64()), "change": pa.array([((new[at:at + block] - old[at:at + block]) * m[:, None]).tobytes()], pa.binary()),
                                                          "n": pa.array([m.tobytes()], pa.binary()), "squares": pa.array([squares[at:at + block].astype(np.float32).tobytes()], pa.binary())})

        def average(batches):
            sums: dict[tuple[str, int], list[np.ndarray]] = {}   # of a few blocks: together never more than the model
            for batch in batches:
                for name, at, c, m, q in zip(*(batch.column(x).to_pylist() for x in ("name", "at", "change", "n", "squares"))):
                    m = np.frombuffer(m, np.float32).astype(np.float64)
                    c = np.frombuffer(c, np.float32).reshape(len(m), -1).astype(np.float64)
                    held = sums.setdefault((name, at), [np.zeros_like(c), *(np.zeros_like(m) for _ in range(3))])
                    held[0] += c
                    held[1] += m
                    np.maximum(held[2], m, out=held[2])
                    held[3] += np.frombuffer(q, np.float32)
            for (name, at), (c, m, most, squares) in sums.items():
                parts = [x.astype(np.float32).tobytes() for x in (c / np.maximum(m, 1)[:, None], np.maximum(m, 1) / np.maximum(most, 1), squares)]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)], names=["name", "at", "change", "spread", "squares"])

        low, done = done / total, done + share
        chosen = training.filter((part >= low) & (part < done / total if done < total else F.lit(True))).select("_text")
        changes = chosen.mapInArrow(returning(learn), "name string, at long, change binary, n binary, squares binary")
        change = Weights()
        spread = {"outer": np.ones(len(change.outer), np.float32), "inner": np.ones(len(change.inner), np.float32)}
        for r in changes.repartition("name", "at").mapInArrow(average, "name string, at long, change binary, spread binary, squares binary").collect():
            rows = np.frombuffer(r.change, np.float32).reshape(-1, WIDTH)
            getattr(change, r.name)[r["at"]:r["at"] + len(rows)] = rows
            spread[r.name][r["at"]:r["at"] + len(rows)] = np.frombuffer(r.spread, np.float32)
            getattr(change, f"{r.name}2")[r["at"]:r["at"] + len(rows)] = np.frombuffer(r.squares, np.float32)
        shared.unpersist()
        weights = merged(weights, change, spread, best_power(last, vocabulary, weights, change, spread) if done < total else 0.0)
    vocabulary.unpersist()
    return weights


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, fold: int = 10,
                    head: int = HEAD, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """Columns ``keep`` (all by default) with held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows whose key is not held out, and scores all. base_score is the log10 probability under
    counts smoothed by a tenth, score that of the model. A null or empty text is the end alone; equal rows get equal
    scores; with nothing to learn from every word is unknown; an empty table gives an empty result. Training depends on
    how documents are dealt to tasks, so scores agree between runs only for equal partitions. Input columns named like
    an added one are replaced.
    """
    added = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    frame = small_batches(docs).select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(names)], held_out(F.col(key), fold).alias("held_out"), F.col(text).alias("_text"))
    training = frame.filter(~F.col("held_out")).select("_text")
    counts = stored(word_counts(training, "_text"), "word-counts")
    v = vocabulary_of(counts, head)
    weights = train(training, v, shares)
    shared = docs.sparkSession.sparkContext.broadcast((weights, v))   # the model's fixed size and at most ``head`` words
    carried = [c for c in frame.columns if c != "_text"]
    schema = StructType([*frame.select(*carried).schema.fields, *StructType.fromDDL(
        "row long, n_tokens long, known long, base double, score double, tail array<struct<word:binary,cls:int>>").fields])

    def score(batches):
        w, v = shared.value
        codes, at = Codes(v.head), TaskContext.get().partitionId() << 36
        logs = np.log10((v.counts + DELTA) / v.base)
        for batch in _texts(batches, "_text"):
            columns, rare_words, rare_classes, rare_sizes = [], [], [], []
            for words, sizes, s in _streams(iter([batch]), codes, v):
                part = log10_parts(w, s, v)
                base = np.where(s.head, logs[np.where(s.head, s.codes, 0)] if len(logs) else 0.0, 0.0)
                begin = np.cumsum(sizes) - sizes
                known = np.add.reduceat(s.head.astype(np.int64), begin)
                columns.append((sizes, known, np.add.reduceat(base, begin), np.add.reduceat(part, begin)))
                rare = np.flatnonzero(~s.head)
                rare_words.append(words.take(pa.array(rare)))
                rare_classes.append(s.cls[rare])
                rare_sizes.append(sizes - known)
            if columns:
                arrays = [np.concatenate(c) for c in zip(*columns)]
                n = len(arrays[0])
                rare = pa.StructArray.from_arrays([pa.concat_arrays(rare_words), pa.array(np.concatenate(rare_classes), pa.int32())], fields=list(_RARE))
                ends = np.concatenate([[0], np.cumsum(np.concatenate(rare_sizes))])
                tails = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare, type=pa.list_(_RARE))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(range(at, at + n), pa.int64()), *map(pa.array, arrays), tails], names=schema.names)
                at += n

    scored = stored(frame.mapInArrow(returning(score), schema), "scored-heads")
    rooms = F.array(*[F.lit(float(x)) for x in v.room])
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.*")
    met = tail.join(counts.select("word", F.col("n").alias("c")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = lambda room: F.sum(F.log10((F.col("c") + DELTA) / room))
    sums = met.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("known_too"), log(F.lit(float(v.base))).alias("base_too"),
                                  log(F.get(rooms, F.col("cls"))).alias("score_too"))
    out = scored.drop("tail").join(sums, "row", "left")
    plus = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)], "held_out", "n_tokens", plus("known", "known_too", 0).alias("n_known"),
                      F.lit(v.total).cast("long").alias("train_tokens"), plus("base", "base_too", 0.0).alias("base_score"), plus("score", "score_too", 0.0).alias("score"))


_RARE = pa.struct([("word", pa.binary()), ("cls", pa.int32())])
