"""Token ids as a range-asymmetric-numeral-system file: one static frequency table, independent interleaved blocks.

File format: a Parquet table with one row per block (``BLOCK_SCHEMA``). A block holds whole documents, so blocks are
decoded in parallel and alone; ``start`` and ``doc_starts`` are the checkpoints from which any document is found, and
``crc32`` covers the block's decoded ids. The frequency table is a second Parquet table (``id``, ``freq``), scaled to
``2 ** SCALE_BITS``. Within a block the ids are dealt to ``lanes`` coders row by row; a coder's state stays in
``[2 ** 32, 2 ** 64)`` and gives off 32-bit words, stored in the order in which the decoder asks for them.

The coder works on all lanes at once in numpy; Spark deals the documents to ordered partitions, counts the ids and
runs one task per group of blocks.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm.shared import held, returning, slices, small_batches, stored
from millrace.plans.lineage import scratch_path

SCALE_BITS = 20
LOW, WORD = np.uint64(1 << 32), np.uint64(32)
MAX_LANES = 1024
BLOCK_IDS = 1 << 18          # a block ends with the document that brings it to so many ids
CACHED_PIECES = 800_000      # pieces of text whose ids a worker remembers, or as many as one more group of texts brings

BLOCK_SCHEMA = ("part int, first_row long, start long, n_ids long, lanes int, crc32 long, doc_keys array<string>, "
                "doc_starts array<long>, states binary, words binary")


# --- the coder ---------------------------------------------------------------------------------------------------

def scaled_frequencies(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Frequencies that sum to 2 ** SCALE_BITS, at least one for every id that occurs and for one that does not."""
    total = 1 << SCALE_BITS
    freq = np.zeros(size, np.int64)
    if len(ids):
        freq[ids] = np.maximum(1, counts.astype(np.float64) / counts.sum() * (total - 2 * len(ids) - 1)).astype(np.int64)
    spare = total - int(freq.sum())
    if spare < 0:
        raise ValueError(f"{len(ids)} distinct ids don't fit in a table of {total}")
    # what is left goes to the commonest id, but for one unit: a lone id must not fill the table
    if len(ids):
        freq[ids[np.argmax(counts)]] += spare - 1
    return freq


def encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(lanes, final states, words) of the ids of a block."""
    lanes = int(min(MAX_LANES, 1 << max(0, int(len(ids)).bit_length() - 6)))
    x = np.full(lanes, LOW, np.uint64)
    chunks: list[np.ndarray] = []
    f_all, c_all, steps = freq[ids].astype(np.uint64), cum[ids].astype(np.uint64), -(-len(ids) // lanes)
    shift, up = np.uint64(SCALE_BITS), np.uint64(64 - SCALE_BITS)
    for t in range(steps - 1, -1, -1):
        f, c = f_all[t * lanes:(t + 1) * lanes], c_all[t * lanes:(t + 1) * lanes]
        y = x[:len(f)]
        full = (y >> up) >= f
        if full.any():
            chunks.append(y[full].astype(np.uint32))
            y = np.where(full, y >> WORD, y)
        q = y // f
        x[:len(f)] = (q << shift) + (y - q * f) + c
    return lanes, x, np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)


def decode_block(n: int, lanes: int, states: np.ndarray, words: np.ndarray, freq: np.ndarray, cum: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The ids of a block; ``slots`` gives the id of each of the 2 ** SCALE_BITS slots."""
    x, at, out = states.copy(), 0, np.empty(n, np.uint32)
    words, mask, shift = words.astype(np.uint64), np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    f64, c64 = freq.astype(np.uint64), cum.astype(np.uint64)
    for t in range(-(-n // lanes)):
        width = min(lanes, n - t * lanes)
        y = x[:width]
        slot = y & mask
        ids = slots[slot]
        out[t * lanes:t * lanes + width] = ids
        y = f64[ids] * (y >> shift) + slot - c64[ids]
        low = y < LOW
        k = int(np.count_nonzero(low))
        if k:
            y[low] = (y[low] << WORD) | words[at:at + k]
            at += k
        x[:width] = y
    if at != len(words) or (x != LOW).any():
        raise ValueError("a block of ids is damaged: its coders don't end where they began")
    return out


def slot_table(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative frequencies, and the id of each slot (the slot that no id has belongs to id 0)."""
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]])
    slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    return cum, np.concatenate([slots, np.zeros((1 << SCALE_BITS) - len(slots), np.uint32)])


# --- text to ids -------------------------------------------------------------------------------------------------

#: A space between two characters that are not white space.
_JOINT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
FIRST = "\ud800"    # marks the first piece of a text, the only one that no space comes before; no text can hold it
#: Letters or digits and marks (but for the apostrophe) behind them, or marks alone: a byte-level tokenizer with the usual pattern makes each
#: of the two runs one unit, and the space before belongs to the first.
_MARKS = "[!-&(-/:-@\\[-`{-~]"
_PLAIN = re.compile(f"( ?(?:[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9]+))({_MARKS}*)|( ?{_MARKS}+)")


def pieces(text: str) -> list[str]:
    """The text cut at the spaces before which a byte-level tokenizer with the usual pattern always ends a token, namely those
    between two characters that are not white space; these spaces are left out."""
    alone = text[0] != " " and text[-1] != " " and "  " not in text and " \n" not in text and "\n " not in text
    # the other white space is rare: one search each costs less than looking at every character
    cut = text.split(" ") if alone and not any(c in text for c in _OTHER_SPACE) else _JOINT.split(text)
    cut[0] = FIRST + cut[0]
    return cut


class PieceIds(dict):
    """Piece to row of a ragged table of ids. The first ``CACHED_PIECES`` pieces that a worker meets are remembered; they include
    all frequent ones. Others live for the group of texts in which they are found."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        super().__init__()
        self.encode, self.new = encode, []
        self.flat, self.begin, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = row = len(self)
        return row

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids per text."""
        known = len(self)
        gc.disable()   # many small objects and no cycles: collections would only take time
        cut = [pieces(t) if t else [] for t in texts]
        rows = np.fromiter(chain.from_iterable(map(self.__getitem__, c) for c in cut), np.int64, sum(map(len, cut)))
        flat, begin, length = self.flat, self.begin, self.length
        if self.new:
            found = self.encode([p[1:] if p[0] == FIRST else " " + p for p in self.new])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            begin = np.concatenate([begin, len(flat) + np.cumsum(sizes) - sizes])
            length = np.concatenate([length, sizes])
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
            if known < CACHED_PIECES:
                self.flat, self.begin, self.length = flat, begin, length
            else:
                for p in self.new:
                    del self[p]
            self.new = []
        size = length[rows]
        ends = np.cumsum(size)
        flat = flat[np.repeat(begin[rows] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.cumsum([0, *map(len, cut)])
        bound = np.concatenate([[0], ends])[cuts]
        gc.enable()
        return [flat[bound[i]:bound[i + 1]] for i in range(len(texts))]


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in own)}


class ByteBpe:
    """The tokenizer library's ids of many short pieces. Pieces that are one or two units of the vocabulary's pre-tokenizer go through the
    library's model unit by unit; all others go through the whole tokenizer. Strings of special tokens in a text become their ids, as by the
    library's default, or are ordinary text if ``special_as_text``."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark has a task for each core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        self.model = self.whole.model
        self.table = str.maketrans({chr(b): c for b, c in byte_characters().items()})

    def unit(self, text: str) -> list[int]:
        """One unit of letters, digits or marks."""
        text = text.replace(" ", self.table[32]) if text.isascii() else text.encode("utf-8").decode("latin-1").translate(self.table)
        return [t.id for t in self.model.tokenize(text)]

    def __call__(self, new: list[str]) -> list[list[int]]:
        units: dict[str, list[int]] = {"": []}
        out: list[list[int] | None] = []
        plain, other = _PLAIN.fullmatch, []
        for p in new:
            if m := plain(p):
                for u in m.groups(""):
                    if u not in units:
                        units[u] = self.unit(u)
                word, behind, marks = m.groups("")
                out.append(units[word] + units[behind] if behind else units[word or marks])
            else:
                out.append(None)
                other.append(p)
        rest = iter(self.whole.encode_batch_fast(other, add_special_tokens=False))
        return [next(rest).ids if ids is None else ids for ids in out]


def byte_bpe(path: str, special_as_text: bool = False) -> PieceIds:
    """The ids of the tokenizer file by piece, loaded once per worker and stage."""
    return held((path, special_as_text), lambda: PieceIds(ByteBpe(path, special_as_text)))


# --- Spark jobs --------------------------------------------------------------------------------------------------

@dataclass
class TokenFile:
    """Where a corpus lies: the folders of the blocks and of the frequency table."""
    blocks: str
    table: str


def _grouped(batches: Iterator[pa.RecordBatch], key: str, text: str, chars: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    keys, texts, size = [], [], 0
    for batch in slices(batches, text):
        for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist()):
            keys.append(k)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= chars:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
                 ordered: bool = True, block_ids: int = BLOCK_IDS, special_as_text: bool = False) -> TokenFile:
    """Encode every whole text, append ``end_id`` to each document and write the file below ``folder``.

    Documents lie in ascending ``key`` order (null keys first, equal keys in any order), or in the order of the given
    partitions if not ``ordered``. A null or empty text is the end id alone; an empty table gives a file
    without blocks. Only ``key`` and ``text`` are read. A special token's string in a text becomes its id, as by the tokenizer library's default,
    unless ``special_as_text``.
    """
    spark = docs.sparkSession
    frame = small_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text"))
    if ordered:
        frame = frame.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first())
    frame = frame.select(F.col("key").cast("string").alias("key"), "text")

    def tokens(batches):
        part, row, before, total = TaskContext.get().partitionId(), 0, 0, np.zeros(0, np.int64)
        encoder = byte_bpe(tokenizer, special_as_text)
        for keys, texts in _grouped(batches, "key", "text"):
            ids = [np.append(i, np.uint32(end_id)).astype(np.uint16 if end_id < 65536 and (len(i) == 0 or i.max() < 65536) else np.uint32)
                   for i in encoder.ids(texts)]
            n, sizes = len(ids), np.array([len(i) for i in ids], np.int64)
            c = np.bincount(np.concatenate(ids), minlength=len(total))
            c[:len(total)] += total
            total = c
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array(keys, pa.string()),
                pa.array(sizes), pa.array(before + np.cumsum(sizes) - sizes), pa.array([i.itemsize for i in ids], pa.int32()),
                pa.array([i.tobytes() for i in ids], pa.binary()), pa.nulls(n, counted)], names=names)
            row, before = row + n, before + int(sizes.sum())
        if row:   # a last row without a document: how often each id was found in the task
            seen = np.flatnonzero(total)
            found = [{"id": i, "n": k} for i, k in zip(seen.tolist(), total[seen].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([-1], pa.int64()), pa.nulls(1, pa.string()), pa.array([0], pa.int64()),
                                              pa.array([before], pa.int64()), pa.array([2], pa.int32()), pa.nulls(1, pa.binary()), pa.array([found], counted)], names=names)

    names = ["part", "row", "key", "n", "before", "width", "ids", "counts"]
    counted = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))
    plain = stored(frame.mapInArrow(returning(tokens), "part int, row long, key string, n long, before long, width int, ids binary, "
                                                       "counts array<struct<id: long, n: long>>"), "token-ids")

    seen = plain.filter("row < 0").select(F.inline("counts")).groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    size = int(seen.id.max()) + 1 if len(seen) else 1   # as many rows as the vocabulary has ids
    freq = scaled_frequencies(seen.id.to_numpy(), seen.n.to_numpy(), size)
    parts = plain.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").toPandas()   # one row per partition
    offsets = dict(zip(parts.part.tolist(), (parts.n.cumsum() - parts.n).tolist()))
    shared = spark.sparkContext.broadcast((freq, offsets))

    def blocks(batches):
        freq, offsets = shared.value
        cum, _ = slot_table(freq)
        first, keys, starts, rows, size = None, [], [], [], 0

        def closed():
            ids = np.concatenate(rows).astype(np.uint32)
            lanes, states, words = encode_block(ids, freq, cum)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([first[0]], pa.int32()), "first_row": pa.array([first[1]], pa.int64()), "start": pa.array(starts[:1], pa.int64()),
                "n_ids": pa.array([len(ids)], pa.int64()), "lanes": pa.array([lanes], pa.int32()), "crc32": pa.array([zlib.crc32(ids)], pa.int64()),
                "doc_keys": pa.array([keys], pa.list_(pa.string())), "doc_starts": pa.array([starts], pa.list_(pa.int64())),
                "states": pa.array([states.tobytes()], pa.binary()), "words": pa.array([words.tobytes()], pa.binary())})

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "row", "key", "before", "width"))
            for part, row, key, before, width, raw in zip(*columns, batch.column("ids")):
                if keys and (size >= block_ids or (part, row) != (first[0], first[1] + len(keys))):   # full, or a gap
                    yield closed()
                    keys, starts, rows, size = [], [], [], 0
                if not keys:
                    first = part, row
                rows.append(np.frombuffer(raw.as_buffer(), np.uint16 if width == 2 else np.uint32).copy())
                keys.append(key)
                starts.append(offsets[part] + before)
                size += len(rows[-1])
        if keys:
            yield closed()

    file = TokenFile(f"{folder}/blocks", f"{folder}/frequencies")
    plain.filter("row >= 0").drop("n", "counts").mapInArrow(returning(blocks), BLOCK_SCHEMA).write.parquet(file.blocks)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, freq long").coalesce(1).write.parquet(file.table)
    return file


def read_tokens(spark: SparkSession, file: TokenFile, with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]): one row per document, decoded from the file block by block.

    ``ids`` are little-endian unsigned 32-bit integers. A block whose checksum or coder states don't agree is an error.
    """
    table = spark.read.parquet(file.table).toPandas()   # at most 2 ** SCALE_BITS rows, a vocabulary's size
    freq = np.zeros(int(table.id.max()) + 1 if len(table) else 1, np.int64)
    freq[table.id.to_numpy()] = table.freq.to_numpy()
    shared = spark.sparkContext.broadcast(freq)

    def documents(batches):
        freq = shared.value
        cum, slots = slot_table(freq)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["n_ids"], row["lanes"], np.frombuffer(row["states"], np.uint64), np.frombuffer(row["words"], np.uint32), freq, cum, slots)
                if zlib.crc32(ids) != row["crc32"]:
                    raise ValueError(f"block {row['part']}, {row['first_row']}: checksum of the decoded ids differs")
                at = np.array([*row["doc_starts"], row["start"] + row["n_ids"]], np.int64)
                own = [ids[a:b] for a, b in zip(at[:-1] - row["start"], at[1:] - row["start"])]
                out = [pa.array(row["doc_keys"], pa.string()), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array([zlib.crc32(i) for i in own], pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *[pa.array([i.tobytes() for i in own], pa.binary())] * with_ids],
                                                 names=["key", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    schema = "key string, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return spark.read.parquet(file.blocks).mapInArrow(returning(documents), schema)


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
                     ordered: bool = True, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """Write the documents as a token file in the shared folder and read it back: ``key`` (in its own type), start,
    n_tokens, ids_crc32 and, if wanted, ids."""
    file = write_tokens(docs, scratch_path(docs.sparkSession, "tokens"), tokenizer, key, text, end_id, ordered, special_as_text=special_as_text)
    back = read_tokens(docs.sparkSession, file, with_ids)
    return back.select(F.col("key").cast(docs.schema[key].dataType).alias(key), *[c for c in back.columns if c != "key"])
