"""Main text of web pages by wrapper induction.

Pages are parsed into trees of block elements in which runs of siblings of one shape are folded, as lists and
paragraphs are. The pages of a host are aligned with one page of it, the pivot, by simple tree matching, so that the same
slot of different pages gets one name. A text that the other pages of the host have in the same slot is template, one
that varies is content; the more distinct pages have the slot, the more that counts, from two pages on. Copies of a page
are one page. Counting (host, slot, text hash) is a grouped aggregation that is combined on the map side, and only the
pivot (one folded tree) and the slots of a host are joined back, hot hosts apart.

Markup is a prior: inside of ``article`` or ``main`` a text must recur nearly everywhere to be template, outside of it (on
pages that have one) it must vary clearly to be content, and elsewhere the wrapper alone decides. Only what names another
purpose (``nav``, ``footer``, a class of ``cookie`` …) goes in any case: comments and teasers vary as articles do.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from millrace.llm.shared import slices, small_batches, stored
from millrace.llm.url_filter import host_of
from millrace.plans.lookup import fit_lookup, join_lookup

#: what markup says before the pages are compared: inside of an article, elsewhere, outside of a page's article. The comparison
#: adds up to +2 (no other page has the text there) or takes up to 2 away (all have it)
INSIDE, OPEN, OUTSIDE = 1.5, 0.0, -1.6
LEAST_SHARE = 0.05       # a text in the same slot of fewer of the other pages counts as varying
MOST_DEPTH = 60          # levels of a path; what is nested deeper has the slot of its ancestor there

#: attributes: a value may hold < and > if it is short, and few may hold <, so that a tag without an end is given up soon
_PART = r"""(?:[^'"<>]++|"[^"<]*+"|'[^'<]*+')*+"""
_ATTRIBUTES = rf"""{_PART}(?:(?:"[^"]{{0,2000}}+"|'[^']{{0,2000}}+'){_PART}){{0,8}}+"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)({_ATTRIBUTES})>|<[!?][^<>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math select button object audio video canvas head".split())
UNWANTED = frozenset("nav footer aside form menu dialog".split())
WANTED = frozenset(("article", "main"))
ENDED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: words of class, id and role that name a purpose other than the article
PURPOSE = re.compile(r"""(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsored|sponsor|promos?|banners?|cookies?|consent|gdpr|notices?|alert|menus?|nav|navbar|navigation|breadcrumbs?
    |sidebars?|widgets?|footer|masthead|topbar|comments?|commentlist|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|popup
    |modal|overlay|pagination|pager|toolbar|complementary|contentinfo|hidden)(?:$|[\s_-]|\d)""", re.I | re.X)


class Block:
    """One run of text: the path of its block elements, whether it is named (-1 unwanted, 1 article, 0 open), its text."""
    __slots__ = ("path", "named", "text")

    def __init__(self, path: str, named: int, text: str):
        self.path, self.named, self.text = path, named, text


def parse(page: str | None) -> list[Block]:
    """The page's texts in order, outside of raw elements. Ends that are left out are supplied; stray ends are ignored. A script or style
    without an end takes the rest of the page, as in a browser; other raw elements without one lose their tag alone."""
    page, blocks, run = page or "", [], []
    stack: list[tuple[str, int, str]] = []      # label, named, tag
    path, opened, endless = [], Counter(), set()

    def close() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(Block("/".join(path), stack[-1][1] if stack else 0, text))

    def leave() -> str:
        _, _, tag = stack.pop()
        opened[tag] -= 1
        del path[len(stack):]
        return tag

    pos, size = 0, len(page)
    while pos < size:
        m = TOKEN.search(page, pos)
        run.append(page[pos:m.start() if m else size])
        if not m:
            break
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/") and tag not in endless:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
                if end:
                    pos = end.end()
                else:
                    endless.add(tag)
                    pos = size if tag in ("script", "style") else pos
            continue
        if tag not in BLOCK:
            if tag == "br":
                run.append(" ")
            continue
        close()
        if m[1]:
            if opened[tag] > 0:
                while leave() != tag:
                    pass
            continue
        while stack and tag in ENDED_BY.get(stack[-1][2], ()):
            leave()
        if tag in VOID:
            continue
        parent = stack[-1][1] if stack else 0
        given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
        purpose = " ".join(given.get(k, "") for k in ("class", "id", "role"))
        off = tag in UNWANTED or "hidden" in given or (tag == "header" and parent != 1) or (purpose and PURPOSE.search(purpose) and tag not in ("html", "body"))
        named = -1 if parent == -1 or (off and not (parent == 1 and tag == "header")) else 1 if tag in WANTED else parent
        label = tag + (f".{re.sub(r'[^a-z-]+', '.', given['class'].lower())}" if given.get("class") else "")
        stack.append((label, named, tag))
        opened[tag] += 1
        if len(stack) <= MOST_DEPTH:
            path.append(label)
    close()
    return blocks


# --- trees and their alignment -----------------------------------------------------------------------------------

class Node:
    """An element of a folded tree: siblings of one label are one node."""
    __slots__ = ("label", "children")

    def __init__(self, label: str):
        self.label, self.children = label, {}


def tree_of(paths: Iterator[str]) -> Node:
    root = Node("")
    for path in paths:
        node = root
        for label in path.split("/"):
            node = node.children.setdefault(label, Node(label))
    return root


@lru_cache(maxsize=20_000)
def aligned(own: str, pivot: str) -> dict[str, str]:
    """Own path to pivot path by simple tree matching: equal tags may match, children in order, the most nodes in all;
    equal labels count a little more. What the pivot lacks keeps its path below the match of its parent."""
    a, b = tree_of(own.split("\n")), tree_of(pivot.split("\n"))

    def weight(x: Node, y: Node) -> tuple[float, list]:
        if x.label.split(".")[0] != y.label.split(".")[0]:
            return 0.0, []
        xs, ys = list(x.children.values()), list(y.children.values())
        best = [[0.0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        how: dict[tuple[int, int], list] = {}
        for i, u in enumerate(xs, 1):
            for j, v in enumerate(ys, 1):
                w, inner = weight(u, v)
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w)
                if w:
                    how[i, j] = w, inner
        pairs, i, j = [], len(xs), len(ys)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                pairs.append((xs[i - 1], ys[j - 1], how[i, j][1]))
                i, j = i - 1, j - 1
        return 1 + best[-1][-1] + 0.01 * (x.label == y.label), pairs

    out: dict[str, str] = {}

    def name(x: Node, path: str, to: str, pairs: list) -> None:
        match = {id(u): (v, inner) for u, v, inner in pairs}
        for u in x.children.values():
            here = f"{path}/{u.label}" if path else u.label
            v, inner = match.get(id(u), (u, []))
            there = f"{to}/{v.label}" if to else v.label
            out[here] = there
            name(u, here, there, inner)

    name(a, "", "", weight(a, b)[1])
    return out


# --- Spark jobs --------------------------------------------------------------------------------------------------

class Wrapper:
    """A host's slots: on how many distinct pages each is, and the texts that recur there with the share of the other pages."""

    def __init__(self, held: str | None):
        slots, recurring = json.loads(held) if held else ([], [])
        self.pages = {x["slot"]: x["n"] for x in slots}
        self.share = {(x["slot"], x["hash"]): x["share"] for x in recurring}

    def keeps(self, slot: str, text_hash: int, named: int, main: bool) -> bool:
        if named < 0:
            return False
        n = self.pages.get(slot, 1)
        prior = INSIDE if named else OUTSIDE if main else OPEN
        return prior + 4 * (1 - 1 / n) * (0.5 - self.share.get((slot, text_hash), 0.0)) * (n > 1) >= 0


@lru_cache(maxsize=2_000)
def _wrapper(held: str | None) -> Wrapper:
    return Wrapper(held)


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with text and n_chars.

    Blocks are joined by two line feeds in page order, white space within a block is one space, character references are
    decoded. A null or empty page has the text ''. Pages without host are a host of their own. If nothing of a page would
    be left, the blocks that no markup names otherwise are kept. Equal rows get equal texts; input columns named
    like an added one are replaced. Nesting of any depth and broken markup are read in time proportional to the page.
    """
    names = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    frame = small_batches(pages).select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(names)], host_of(F.col(url)).alias("host"), F.col(html).alias("_html"))
    held = [c for c in frame.columns if c != "_html"]
    schema = StructType([*frame.select(*held).schema.fields, *StructType.fromDDL(
        "page long, tree string, paths array<string>, named array<int>, hashes array<long>, texts array<string>").fields])
    digest = lambda t: xxhash.xxh64_intdigest(t) - (1 << 63)

    def read(batches):
        for batch in slices(batches, "_html"):
            found = [parse(p) for p in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in held], pa.array([digest("\n".join(f"{b.path}\t{b.text}" for b in f)) for f in found], pa.int64()),
                pa.array(["\n".join(dict.fromkeys(b.path for b in f)) for f in found], pa.string()),
                pa.array([[b.path for b in f] for f in found], pa.list_(pa.string())), pa.array([[b.named for b in f] for f in found], pa.list_(pa.int32())),
                pa.array([[digest(b.text) for b in f] for f in found], pa.list_(pa.int64())),
                pa.array([[b.text for b in f] for f in found], pa.list_(pa.string()))], names=schema.names)

    parsed = stored(frame.mapInArrow(read, schema), "parsed-pages")
    # the pivot: the host's tree of most pages, so that one odd page does not name the slots
    trees = parsed.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"))
    pivots = fit_lookup(trees.groupBy("host").agg(F.max(F.struct("n", "tree")).alias("m"), F.sum("n").alias("n")).select("host", F.col("m.tree").alias("pivot"), "n"), ["host"])
    # copies of a page count as one together
    copies = fit_lookup(parsed.groupBy("host", "page").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("copies", F.col("n")), ["host", "page"])

    def with_pivot(*columns):
        return join_lookup(parsed.select("host", *columns, "tree", "paths"), pivots, ["pivot"])

    def named_slots(batch) -> list[list[str]]:
        own = [aligned(t, p or t) for t, p in zip(batch.column("tree").to_pylist(), batch.column("pivot").to_pylist())]
        return [[m[p] for p in paths] for m, paths in zip(own, batch.column("paths").to_pylist())]

    def counted(batches):
        """Each slot of a page once, and each of its texts there once."""
        for batch in batches:
            out = {"host": [], "slot": [], "hash": [], "weight": []}
            for host, copies, slots, hashes in zip(batch.column("host").to_pylist(), batch.column("copies").to_pylist(), named_slots(batch), batch.column("hashes").to_pylist()):
                found = list(dict.fromkeys([(s, None) for s in slots] + list(zip(slots, hashes))))
                out["host"] += [host] * len(found)
                out["slot"] += [f[0] for f in found]
                out["hash"] += [f[1] for f in found]
                out["weight"] += [1.0 / (copies or 1)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out["host"], pa.string()), pa.array(out["slot"], pa.string()), pa.array(out["hash"], pa.int64()),
                                              pa.array(out["weight"], pa.float64())], names=list(out))

    rows = join_lookup(with_pivot("page", "hashes"), copies, ["copies"]).mapInArrow(counted, "host string, slot string, hash long, weight double")
    seen = stored(rows.groupBy("host", "slot", "hash").agg(F.round(F.sum("weight")).cast("long").alias("n")).filter("n > 1"), "recurring-texts")
    slots = seen.filter("hash IS NULL").select("host", "slot", F.col("n").alias("pages"))
    # at most 1 / LEAST_SHARE texts per slot and block of an average page
    share = (F.col("n") - 1) / (F.col("pages") - 1)
    recurring = (seen.filter("hash IS NOT NULL").join(slots.withColumnsRenamed({"host": "h", "slot": "s"}), F.col("host").eqNullSafe(F.col("h")) & (F.col("slot") == F.col("s")))
                 .select("host", "slot", "hash", share.alias("share")).filter(F.col("share") >= LEAST_SHARE))
    parts = slots.select("host", F.struct("slot", F.col("pages").alias("n")).alias("a"), F.lit(None).cast("struct<slot:string,hash:bigint,share:double>").alias("b")).unionByName(
        recurring.select("host", F.lit(None).cast("struct<slot:string,n:bigint>").alias("a"), F.struct("slot", "hash", "share").alias("b")))
    listed = parts.groupBy("host").agg(F.concat(F.lit("["), F.to_json(F.collect_list("a")), F.lit(","), F.to_json(F.collect_list("b")), F.lit("]")).alias("wrapper"))
    pages_of = trees.groupBy("host").agg(F.sum("n").alias("n")).withColumnRenamed("host", "h")
    wrappers = fit_lookup(listed.join(pages_of, F.col("host").eqNullSafe(F.col("h"))).drop("h"), ["host"])
    shown = join_lookup(with_pivot(*[c for c in held if c != "host"], "named", "hashes", "texts"), wrappers, ["wrapper"])

    def chosen(batches):
        for batch in batches:
            texts = []
            columns = (batch.column(c).to_pylist() for c in ("wrapper", "named", "hashes", "texts"))
            for (held_wrapper, named, hashes, own), slots in zip(zip(*columns), named_slots(batch)):
                wrapper, main = _wrapper(held_wrapper), 1 in named
                kept = [t for t, s, h, k in zip(own, slots, hashes, named) if wrapper.keeps(s, h, k, main)]
                texts.append("\n\n".join(kept or [t for t, k in zip(own, named) if k >= 0]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in inputs], pa.array(texts, pa.string())], names=[*inputs, "text"])

    inputs = [f"in_{i}" for i in range(len(names))]
    out = shown.mapInArrow(chosen, StructType([*shown.select(*inputs).schema.fields, *StructType.fromDDL("text string").fields]))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)], "text", "n_chars")
