"""URL filter: host and path rules, and a blocked Bloom filter of listed addresses before an exact join.

The list is turned into a split-block Bloom filter by one aggregation: an address chooses one block of 512 bits and
sets one bit in each of its eight 64-bit words. The filter is a table of at most ``MAX_BLOCKS`` rows, so it is small
enough to be broadcast whatever the length of the list; with a longer list it only lets more through. What passes goes
to a join on the canonical address itself, so the verdict never depends on the filter's error rate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.shared import ascii_lower, stored

MAX_BLOCKS = 1 << 18        # 16 MB of bits: the largest table that is ever broadcast
BITS_PER_ADDRESS = 16
WORDS = 8                   # 64-bit words of a block
MAX_RULES = 10_000          # rules are literals of the plan

ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` ('allow' or 'block') for a host with all its subdomains, where the path starts with ``path``."""
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, ADDRESS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or a default port, path without trailing slashes, query parameters sorted and without tracking ones;
    scheme and fragment go. Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(F.coalesce(F.regexp_extract(url, ADDRESS, 3), F.lit("")), "&"),
                                 lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.array_join(kept, "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The fitting rule whose text is longest (then the one with the longer host) as a struct, or null."""
    if not rules:
        return F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    table = F.array(*[F.struct(F.lit(len(r.text)).alias("size"), F.lit(len(r.host)).alias("host_size"), F.lit(r.text).alias("rule"),
                               F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path")) for r in rules])
    fits = F.filter(table, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["host_size"], r["rule"], r["verdict"])))


def _place(address: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of an address and the bit it has in each word of the block."""
    second = F.xxhash64(address, F.lit(1))
    bits = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return (F.pmod(F.xxhash64(address), F.lit(blocks)).cast("int"),
            [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits])


def bloom(listed: DataFrame, address: str, blocks: int) -> DataFrame:
    """(block, w0 … w7): the non-empty blocks, by one map-side combined aggregation."""
    block, bits = _place(F.col(address), blocks)
    placed = listed.filter(F.col(address).isNotNull()).select(block.alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
    return placed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url", listed_url: str = "url",
                max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """All rows of ``pages`` with host, path, canonical, rule, listed and verdict added.

    The longest fitting rule decides; without one an address is blocked when its canonical form is in ``listed``.
    Null or malformed urls have empty host and path, no canonical form and the verdict 'allow' unless a rule fits;
    repeated rows each get their verdict; repeated or null list entries count once or not at all; an empty list
    blocks nothing. Input columns named like an added one are replaced.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit in a plan")
    added = ("host", "path", "canonical", "rule", "listed", "verdict")
    keep = [c for c in pages.columns if c not in added]
    base = pages.select(F.struct(*keep).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical(F.col(url)).alias("canonical"))
    judged = base.select("*", _rule_of(F.col("host"), F.col("path"), rules).alias("best")).select(*base.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))

    names = stored(listed.select(canonical(F.col(listed_url)).alias("name")).filter("name is not null").distinct(), "listed-addresses")
    blocks = int(min(max_blocks, max(1, names.count() * BITS_PER_ADDRESS // (64 * WORDS) + 1)))
    block, bits = _place(F.col("canonical"), blocks)
    hit = F.col("w0").isNotNull() & F.col("canonical").isNotNull()
    for i, b in enumerate(bits):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) == b)
    tested = (judged.withColumn("block", block).join(F.broadcast(bloom(names, "name", blocks)), "block", "left")
              .select(*judged.columns, F.coalesce(hit, F.lit(False)).alias("maybe")))
    sure = tested.filter("not maybe").select(*judged.columns, F.lit(False).alias("listed"))
    exact = (tested.filter("maybe").join(names, F.col("canonical") == F.col("name"), "left")
             .select(*judged.columns, F.col("name").isNotNull().alias("listed")))
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict")
    return sure.unionByName(exact).select("page.*", "host", "path", "canonical", "rule", "listed", verdict)
