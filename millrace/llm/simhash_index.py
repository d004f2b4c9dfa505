"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A 64-bit fingerprint is a set of eight positional bytes. Fingerprints that differ in at most four bits differ in at
most four bytes, so they share at least four positional bytes (the guaranteed minimum). The index lists fingerprints
by three positional bytes at a time: 20 triples of the eight positions are enough for any four positions to hold one
of them (Turan's design), and a list holds one fingerprint in 2 ** 24 by chance where a list of a single byte
would hold one in 256. Within a list the shared positional bytes of each pair are tallied, pairs below the
minimum go, and the rest are verified by their differing bits.

A list that is longer than ``LIST_LIMIT`` is indexed again by what its pairs must share beyond the list's key: a fourth
byte, then three of the eight half-bytes that are left, then a fourth. What is left then has 16 free bits, so
no list can exceed 65 536 fingerprints, whatever the corpus. Each task keeps a spanning forest of the links it
verified rather than all pairs of a dense list.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.shared import free_name, returning, slices, small_batches, stored
from millrace.operators.graph import connected_components

SHINGLE, SEED, MAX_BITS, MIN_BYTES = 4, 42, 4, 4
LIST_LIMIT = 512


def triples() -> list[tuple[int, ...]]:
    """Twenty triples of eight positions such that any four positions contain one: with the positions in three groups
    placed in a circle, all triples inside a group and those with two in a group and one in the next."""
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    found = []
    for i, g in enumerate(groups):
        found += list(combinations(g, 3)) + [(*pair, other) for pair in combinations(g, 2) for other in groups[(i + 1) % 3]]
    assert all(any(set(t) <= set(four) for t in found) for four in combinations(range(8), 4))
    return found


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) text's shingles, repeats included. A shorter text is one shingle; without words it has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, repeats included; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    return simhash(hashes) if len(hashes) else 0


def simhash(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def with_fingerprints(docs: DataFrame, text: str, name: str, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` and the fingerprint as a signed long."""
    schema = docs.select(*keep).schema.add(name, "long")
    batch_text = free_name(docs.columns, "_text")
    frame = small_batches(docs).select(F.col(text).alias(batch_text), *keep)

    def work(batches):
        for batch in slices(batches, batch_text):
            prints = pa.array([fingerprint(t, shingle) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], prints], names=[*batch.schema.names[1:], name])

    return frame.mapInArrow(returning(work), schema)


# --- the index ---------------------------------------------------------------------------------------------------

def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _half(fp: Column, i: Column | int) -> Column:
    return F.shiftrightunsigned(fp, 4 * i).bitwiseAND(F.lit(15))


def _byte_lists(fps: DataFrame) -> DataFrame:
    """(key, shared, fp): the fingerprint in its 20 lists; ``shared`` has a bit per half-byte that the list fixes. Keys are
    hashes: lists that meet by chance only make more pairs to verify."""
    lists = []
    for t in triples():
        key = sum((F.shiftleft(_byte(F.col("fp"), p), 8 * k) for k, p in enumerate(t)), F.lit(0).cast("long"))
        lists.append(F.struct(key.alias("value"), F.lit(sum(3 << 2 * p for p in t)).alias("shared")))
    return fps.select("fp", F.explode(F.array(*lists)).alias("l")).select(F.xxhash64("l.shared", "l.value").alias("key"), F.col("l.shared").alias("shared"), "fp")


def _finer_lists(lists: DataFrame, level: int) -> DataFrame:
    """The lists' members again, by more of what they must share. Level 1: a fourth byte. 2 and 3: three half-bytes of
    the four bytes that are left, then a fourth."""
    fp, shared = F.col("fp"), F.col("shared")
    options = []
    if level == 1:
        for p in range(8):
            mask = 3 << 2 * p
            options.append(F.when(shared.bitwiseAND(F.lit(mask)) == 0, F.struct(F.xxhash64(F.lit(p), _byte(fp, p)).alias("value"), F.lit(mask).alias("mask"))))
        more = F.array_compact(F.array(*options))
    else:
        free = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda h: F.call_function("shiftright", shared, h).bitwiseAND(F.lit(1)) == 0)
        at = lambda k: F.get(F.col("_free"), F.lit(k))  # noqa: E731  the k-th half-byte that is not fixed yet
        half = lambda h: F.call_function("shiftrightunsigned", fp, (h * 4).cast("int")).bitwiseAND(F.lit(15))
        bit = lambda h: F.call_function("shiftleft", F.lit(1), h.cast("int"))
        lists = lists.withColumn("_free", free)
        for t in (triples() if level == 2 else [(k,) for k in range(5)]):
            options.append(F.struct(F.xxhash64(*[x for k in t for x in (at(k), half(at(k)))]).alias("value"),
                                    sum((bit(at(k)) for k in t[1:]), bit(at(t[0]))).alias("mask")))
        more = F.array(*options)
    return (lists.select("key", "shared", "fp", F.explode(more).alias("m"))
            .select(F.xxhash64("key", "m.value").alias("key"), shared.bitwiseOR(F.col("m.mask")).alias("shared"), "fp").distinct())


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links: each linked node with the smallest of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, r) for x in parent if (r := root(x)) != x]


def verified(key: np.ndarray, fp: np.ndarray, max_bits: int, min_bytes: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key (rows sorted by key). At step s each row meets the one s places on; rows whose list is
    shorter drop out, so the work is the number of pairs in the lists."""
    at, links = np.arange(len(fp)), []
    for s in range(1, len(fp)):
        at = at[at + s < len(fp)]
        at = at[key[at] == key[at + s]]
        if not len(at):
            break
        for k in range(0, len(at), block):
            i = at[k:k + block]
            differ = fp[i] ^ fp[i + s]
            tally = np.count_nonzero(differ.view(np.uint8).reshape(-1, 8) == 0, axis=1)   # shared positional bytes
            i = i[(tally >= min_bytes) & (tally < 8)]
            i = i[np.bitwise_count((fp[i] ^ fp[i + s]).view(np.uint64)) <= max_bits]
            links.append((fp[i], fp[i + s]))
    return tuple(np.concatenate(x) if links else np.zeros(0, np.int64) for x in (zip(*links) if links else ((), ())))


def _within_lists(lists: DataFrame, max_bits: int, min_bytes: int) -> DataFrame:
    """(src, dst): links found in the lists, as a forest per batch of whole lists."""
    def work(batches):
        key, fp = None, np.zeros(0, np.int64)

        def found(key, fp):
            a, b = verified(key, fp, max_bits, min_bytes)
            pairs = _forest(a, b)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["src", "dst"])

        for batch in batches:
            new = batch.column(0).to_numpy(zero_copy_only=False)
            key = new if key is None else np.concatenate([key, new])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if len(fp) < 100_000:
                continue
            # the last list may go on in the next batch
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield found(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(fp):
            yield found(key, fp)

    dealt = lists.select("key", "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(returning(work), "src long, dst long")


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, min_bytes: int = MIN_BYTES, limit: int = LIST_LIMIT) -> DataFrame:
    """(src, dst): links that connect exactly the fingerprints (distinct, in column ``fp``) that chains of at most
    ``max_bits`` differing bits connect."""
    if min_bytes < 4 or max_bits > 8 - min_bytes:
        raise ValueError("lists of three bytes find the pairs that share four: max_bits + min_bytes may be 8 at most, min_bytes 4 at least")
    lists, found = _byte_lists(fps), None
    for level in range(1, 5):
        long = None
        if level < 4:
            sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("key")
            long = stored(sizes, f"long-lists-{level}")
            if long.isEmpty():
                long = None
        short = lists if long is None else lists.join(long, "key", "left_anti")
        links = _within_lists(short, max_bits, min_bytes)
        found = links if found is None else found.unionByName(links)
        if long is None:
            break
        lists = stored(_finer_lists(lists.join(long, "key", "left_semi"), level), f"lists-{level}")
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None,
                    limit: int = LIST_LIMIT, shingle: int = SHINGLE, max_bits: int = MAX_BITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Columns ``keep`` (all by default) with fingerprint (16 hex digits), component_id (the smallest id reachable) and
    component_print (the smallest fingerprint, as a signed number, reachable).

    Texts link when their fingerprints differ in at most ``max_bits`` (four) bits. Null and empty texts have fingerprint zero and link
    like any other. Null ids are never a component's id unless it has no other. Equal rows stay and are linked.
    An empty table gives an empty result. Input columns named like an added one are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("fingerprint", "component_id", "component_print")]
    inner = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(names)], F.col(id_col).alias("id"), F.col(text).alias("_text"))
    printed = stored(with_fingerprints(inner, "_text", "fp", [c for c in inner.columns if c != "_text"], shingle), "fingerprints")
    least = stored(printed.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    links = stored(fingerprint_links(least.select("fp"), max_bits, min_bytes, limit), "fingerprint-links")
    if links.isEmpty():
        linked = least.select("fp", F.col("least").alias("component_id"), F.col("fp").alias("root"))
    else:
        reach = connected_components(links).select(F.col("id").alias("fp"), F.col("component").alias("root"))
        rooted = least.join(reach, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        linked = stored(stored(rooted, "rooted").join(stored(ids, "component-ids"), "root").select("fp", "component_id", "root"), "components")
    out = printed.join(linked, "fp", "left")
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)], digits("fp").alias("fingerprint"), "component_id",
                      digits("root").alias("component_print"))


def _with_key(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, str]:
    """``docs`` with a digest of id and text."""
    key = free_name(docs.columns, "_key")
    return docs.withColumn(key, F.md5(F.concat_ws("#", F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-")), F.md5(F.coalesce(F.col(text), F.lit("")))))), key


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                min_bytes: int = MIN_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component is kept: the one with the smallest id (null ids
    last), of rows with that id the one whose digest is smallest, of rows equal in id and text one."""
    keyed, key = _with_key(docs, id_col, text)
    judged = near_duplicates(keyed, id_col, text, keep=[id_col, key], shingle=shingle, max_bits=max_bits, min_bytes=min_bytes)
    return _first_rows(keyed, key, id_col, judged.select(id_col, key, "component_print"), "component_print").select(*docs.columns)


def _first_rows(keyed: DataFrame, key: str, id_col: str, judged: DataFrame, component: str) -> DataFrame:
    """The row of each component that ``one_of_each`` keeps."""
    first = judged.groupBy(component).agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(key).alias("key"))).alias("m")).select("m.key")
    stay = stored(first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.col("key").alias(key)), "one-of-each")
    twice = stored(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key), "rows-twice")
    if twice.isEmpty():
        return keyed.join(stay, key, "left_semi")
    single = keyed.join(stay.join(twice, key, "left_anti"), key, "left_semi")
    several = keyed.join(stay.join(twice, key, "left_semi"), key, "left_semi").dropDuplicates([key])
    return single.unionByName(several)
