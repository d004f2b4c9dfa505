"""Plain Python statements of what the corpus queries return."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def token_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encoded(rows):
    """doc_id -> (start, n_tokens, crc32) of rows (doc_id, text) with distinct ids."""
    rows, start, out = sorted(rows), 0, {}
    for (doc, _), ids in zip(rows, token_ids([t for _, t in rows])):
        out[doc] = start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    return out


def fingerprint(text):
    words = SPACED.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, prints=None):
    """doc_id -> (fingerprint, component_id), by comparing all fingerprints with all others."""
    prints = prints or {d: fingerprint(t) for d, t in rows}
    distinct = np.array(sorted(set(prints.values())), np.uint64)
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1:] ^ distinct[i]) <= 4) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    of = {int(f): root(i) for i, f in enumerate(distinct)}
    least = {}
    for d, f in prints.items():
        least[of[f]] = min(d, least.get(of[f], d))
    return {d: (f"{f:016x}", least[of[f]]) for d, f in prints.items()}


def contamination(rows, items, n=13):
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        w = word.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).update([] if item is None else [str(item)])
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in rows:
        w, hit, found = word.findall((text or "").translate(LOWER)), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (o := windows.get(tuple(w[i:i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= o
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def language_model_base(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    words = {d: [*SPACED.findall((t or "").translate(LOWER)), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    seen = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(seen.values()), len(seen)
    return {d: (held[d], len(ws), sum(w in seen for w in ws), n, sum(np.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in words.items()}


def article(page):
    """The blocks of the one article element of a test page, with the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        inside, blocks = False, None

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside, self.blocks = True, [""]
            elif self.inside and tag in ("p", "h1", "h2", "h3", "ul", "li", "div"):
                self.blocks.append("")
            elif self.inside and tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside = False
            elif self.inside and tag in ("p", "h1", "h2", "h3", "ul", "li", "div"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    reader = Reader()
    reader.feed(page)
    reader.close()
    return "\n\n".join(b for x in reader.blocks or [] if (b := " ".join(x.split())))


def copies(rows, flatten=0.5, seed=1):
    """(doc_id, copies) of rows (doc_id, text, source) under Poisson replication."""
    import math

    size = Counter()
    for _, t, s in rows:
        size[s] += max(1, len(t or ""))
    total, shares = sum(size.values()), sum(x ** flatten for x in size.values())
    out = {}
    for d, t, s in rows:
        rate = size[s] ** flatten / shares * total / size[s]
        digest = hashlib.md5((t or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{d}#{digest}#1#{seed}".encode()).hexdigest()[:13], 16) / 2 ** 52
        k, p, cdf = 0, math.exp(-rate), math.exp(-rate)
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        out[d] = k
    return out
