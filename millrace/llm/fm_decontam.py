"""Benchmark decontamination with an FM-index per shard of the training documents.

A task turns the documents it is dealt into shards of about ``SHARD_WORDS`` words and indexes each by word ids: the
Burrows-Wheeler transform of the word sequence in a wavelet matrix, with sampled suffix positions. All test
phrases (windows of 13 words) are searched backwards at once, their occurrences are located through the samples, and
the words they cover are merged into removal spans. Documents never leave their task.

The alphabet is that of the phrases: a word that no phrase holds ends a run, and a run shorter than the shortest phrase
can't hold one, so neither is indexed. Runs end in separators that are all different, so that sorting suffixes
takes as many rounds as the longest run has doublings.

The test set is broadcast in blocks of at most ``BLOCK_ITEM_WORDS`` words; a larger one takes more passes over the
documents, each of which adds to the spans of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from millrace.llm.shared import free_name, returning, small_batches, stored

WINDOW = 13
SAMPLE = 16                   # every 16th suffix position is kept
SHARD_WORDS = 1_000_000
BLOCK_ITEM_WORDS = 400_000   # about 135 MB in the driver and in each worker

#: Fixed by the contract: words are runs of digits, letters and everything beyond ASCII, A-Z lower-cased.
_KEEP = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\\x80-\\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


class WaveletMatrix:
    """Rank queries over a sequence of small integers, one cumulated bit row per level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``, for arrays of both."""
        low, high = np.zeros_like(at), at
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            ones, zeros = self.ones[level], self.zeros[level]
            low = np.where(bit == 1, zeros + ones[low], low - ones[low])
            high = np.where(bit == 1, zeros + ones[high], high - ones[high])
        return high - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Symbol 0 ends a run, and each 0 is smaller than the next 0."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols + int(ends.sum())).astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - width] = rank[width:] + 1
        after[ends] = 0                                  # a separator alone decides
        pair = rank * (n + int(rank.max()) + 2) + after
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        new = np.concatenate([[0], np.cumsum(sorted_pair[1:] != sorted_pair[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class FmIndex:
    """The index of a sequence of symbols 0 … ``size`` - 1, where 0 ends each run and the sequence."""

    def __init__(self, symbols: np.ndarray, size: int, sample: int = SAMPLE):
        order = suffix_order(symbols)
        self.bwt = symbols[order - 1]                    # of the first suffix: the last symbol, a separator
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])[:size]
        self.tree = WaveletMatrix(self.bwt, max(1, int(size - 1).bit_length()))
        # walks end at a sampled position or at the beginning of a run, where the transform has a separator
        kept = (order % sample == 0) | (self.bwt == 0)
        self.sampled = kept
        self.slot = np.cumsum(kept) - 1
        self.position = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each phrase (rows of a right-padded matrix)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = np.flatnonzero((step < lengths) & (low < high))
            symbol = phrases[live, lengths[live] - 1 - step]
            first = self.before[symbol]
            low[live], high[live] = first + self.tree.rank(symbol, low[live]), first + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled row, then add the steps."""
        out, at, steps = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.arange(len(rows))
        while len(walking):
            done = self.sampled[at[walking]]
            here = walking[done]
            out[here] = self.position[self.slot[at[here]]] + steps[here]
            walking = walking[~done]
            symbol = self.bwt[at[walking]]
            at[walking] = self.before[symbol] + self.tree.rank(symbol, at[walking])
            steps[walking] += 1
        return out


class Phrases:
    """A block of the test set: its words, its distinct windows and the items that hold each of them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], dict[str, None]] = {}
        for item, words in items:
            row = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            for k in range(max(1, len(row) - window + 1) if row else 0):
                owners.setdefault(tuple(row[k:k + window]), {})[item] = None
        self.owners = [list(o) for o in owners.values()]
        self.lengths = np.array([len(k) for k in owners], np.int64)
        self.rows = np.zeros((len(owners), window), np.int64)
        for i, k in enumerate(owners):
            self.rows[i, :len(k)] = k

    def occurrences(self, shard: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(document, first word, phrase) for every occurrence in documents given as word ids (0: in no phrase)."""
        if not len(self.lengths):
            return
        flat = np.concatenate([x for d in shard for x in (d, [0])]) if shard else np.zeros(0, np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (flat != 0).astype(np.int8), [0]])))
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= self.lengths.min()
        begin, end = begin[long], end[long]
        if not len(begin):
            return
        size = end - begin + 1                           # with its separator
        place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        index = FmIndex(flat[place].astype(np.int64), len(self.ids) + 1)
        low, high = index.search(self.rows, self.lengths)
        n = high - low
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        where = place[index.locate(rows)]
        starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in shard])])
        doc = np.searchsorted(starts, where, "right") - 1
        yield from zip(doc.tolist(), (where - starts[doc]).tolist(), np.repeat(np.arange(len(n)), n).tolist())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans in order, with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def character_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of code points, from the first word's first to the last word's last."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


STATE = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "word_spans": pa.list_(pa.list_(pa.int64())),
         "spans": pa.list_(pa.list_(pa.int64()))}
_DDL = "n_words long, n_hit long, items array<string>, word_spans array<array<long>>, spans array<array<long>>"


def item_blocks(benchmark: DataFrame, item: str, text: str, limit: int = BLOCK_ITEM_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test items with their words, in blocks of about ``limit`` words; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).toLocalIterator():
        block.append((row["item"], words_of(row["text"])))
        size += len(block[-1][1])
        if size >= limit:
            yield block
            block, size = [], 0
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                       keep: list[str] | None = None, window: int = WINDOW, share: int = 20, shard_words: int = SHARD_WORDS,
                       block_words: int = BLOCK_ITEM_WORDS) -> DataFrame:
    """Columns ``keep`` (all by default) with n_words, n_hit, items, spans (code points to remove) and contaminated.

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer but not none. A document's
    word inside any occurrence of a window is hit; contaminated: ``n_hit`` > 0 and ``share * n_hit >= n_words``. Null and
    empty texts have no words; items without words hit nothing; an item without id hits like any other but is not among ``items``;
    repeated items and rows count each by itself; empty tables give empty or untouched results. Input columns named like an added one are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in (*STATE, "contaminated")]
    body = free_name(docs.columns, "_body")
    frame = small_batches(docs).select(*names, F.col(text).alias(body))
    state: list[str] = []
    blocks = item_blocks(benchmark, item, item_text, block_words)
    block, last = next(blocks), False
    while not last:
        following = next(blocks, None)
        last = following is None
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))
        carried = names if last else [*names, body]
        frame = _pass(frame, body, carried, bool(state), phrases, shard_words)
        if not last:   # settled before the next block's phrases are made, so that one block is held at a time
            frame = stored(frame, "contamination-so-far")
            phrases.unpersist()
        state, block = list(STATE), following
    hit = (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))
    return frame.drop("word_spans").withColumn("contaminated", hit)


def _pass(frame: DataFrame, body: str, carried: list[str], again: bool, phrases, shard_words: int) -> DataFrame:
    """One block of phrases against all documents; ``again``: earlier blocks left their results in the rows."""
    def search(batches: list[pa.RecordBatch], shard: list[np.ndarray], texts: list[str]) -> Iterator[pa.RecordBatch]:
        block = phrases.value
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[dict[str, None]] = [{} for _ in texts]
        if again:
            at = 0
            for batch in batches:
                for own, held in zip(batch.column("word_spans").to_pylist(), batch.column("items").to_pylist()):
                    spans[at], items[at] = [tuple(s) for s in own], dict.fromkeys(held)
                    at += 1
        for doc, word, k in block.occurrences(shard):
            spans[doc].append((word, word + int(block.lengths[k])))
            items[doc].update(dict.fromkeys(o for o in block.owners[k] if o is not None))
        at = 0
        for batch in batches:
            own = range(at, at + batch.num_rows)
            at += batch.num_rows
            joined = [merged(spans[i]) for i in own]
            values = {"n_words": [len(shard[i]) for i in own], "n_hit": [sum(b - a for a, b in s) for s in joined], "items": [sorted(items[i]) for i in own],
                      "word_spans": joined, "spans": [character_spans(texts[i], s) if s else [] for i, s in zip(own, joined)]}
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *[pa.array(values[c], STATE[c]) for c in STATE]], names=[*carried, *STATE])

    def work(batches):
        get = phrases.value.ids.get
        held, shard, texts, size = [], [], [], 0
        for batch in batches:
            held.append(batch)
            for t in batch.column(body).to_pylist():
                words = words_of(t)
                shard.append(np.fromiter([get(w, 0) for w in words], np.int64, len(words)))
                texts.append(t or "")
                size += len(words)
            if size >= shard_words:
                yield from search(held, shard, texts)
                held, shard, texts, size = [], [], [], 0
        if held:
            yield from search(held, shard, texts)

    return frame.mapInArrow(returning(work), StructType([*frame.select(*carried).schema.fields, *StructType.fromDDL(_DDL).fields]))


def without_spans(text, spans):
    """The text without its removal spans, as a column: what lies between them, joined by one space."""
    cuts = F.concat(F.array(F.array(F.lit(0), F.lit(0)).cast("array<bigint>")), spans)
    parts = F.transform(cuts, lambda s, i: F.substring(text, (s[1] + 1).cast("int"), F.coalesce(F.get(spans, i)[0] - s[1], F.length(text).cast("long")).cast("int")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.filter(F.transform(parts, lambda p: F.btrim(p)), lambda p: p != ""), " "))
