"""Main content of web pages by site style trees (Yi, Liu and Li, 2003).

The DOM trees of a host's pages are merged: an element node of the merged tree stands for all elements with the same
path of tags and style attributes from the root, and counts, over pages, the presentation styles (sequences of child
tags) and the content features (words, link targets) that occur there. A node that always looks the same and says the
same on all pages is template; entropy measures that:

* presentation importance of a node: the entropy of its styles, to the base of the pages that have it (1 for one page);
* content importance of a leaf: 1 minus the mean entropy of its features over pages, to the same base;
* a node's importance: ``(1 - GAMMA^l)`` of its presentation importance, and ``GAMMA^l`` of the mean importance of its
  children, weighted by pages and features, ``l`` being the number of its child tags.

Branches in which no node reaches a least importance are removed from each page; what is left is its text. The least
importance is set by the host's main content, the node with the most features: on few pages all features are rare. It is lower by one
in the number of pages, so that on two pages, where chance makes much of what differs, a branch must say mostly the same.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, documents
from tessera.llm.tokens import U64, Words, mix, slices

GAMMA = 0.9
#: Branches are removed that lack FACTOR times as much importance to 1 as the node with the most features, the main content.
FACTOR = 1.6
#: Rows that the features of one node are parted into, by hash.
PARTS = 16
#: Bytes of all hosts' trees up to which they are sent to every executor.
SENT = 8 << 20
#: Elements that are never content, and that have no end tag.
DEAD = frozenset("script style noscript template iframe svg canvas object head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end the text before them.
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td th thead tr ul".split())
#: What an open element of the same kind ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(script|style|noscript|template|iframe|svg|canvas|object)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_STYLE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LINK = re.compile(r"\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"\d+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Node:
    __slots__ = ("tag", "key", "parent", "children", "text", "stop")

    def __init__(self, tag: str, key: int, parent: "Node | None"):
        self.tag, self.key, self.parent = tag, key, parent
        # The nearest element, itself included, at which the search for what a start tag ends comes to a stop.
        self.stop: Node = self if parent is None or tag in BLOCKS or tag in CLOSES else parent.stop
        self.children: list[Node | str] = []
        self.text = ""


def _hash(s: str) -> int:
    h = 14695981039346656037
    for c in s.encode():
        h = ((h ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


_kept: dict[tuple[int, str], int] = {}


def _key(parent: int, name: str) -> int:
    """The key of a child: a hash of the path of names from the root."""
    at = (parent, name)
    if at not in _kept:
        if len(_kept) > 200_000:
            _kept.clear()
        x = np.array([parent], U64) * U64(0x9E3779B97F4A7C15) ^ U64(_hash(name))
        _kept[at] = int(mix(x)[0])
    return _kept[at]


def parse(html: str) -> Node:
    """A tree of whatever text: unknown ends are ignored, missing ones added, text stays in order. Its time is in
    proportion to the text's length: each element is left once, and an end without an open element looks for none."""
    root = Node("", 1, None)
    at, last = root, 0
    opened: Counter = Counter()

    def leave(up: Node) -> Node:
        x = at
        while x is not up.parent:
            opened[x.tag] -= 1
            x = x.parent
        return x

    for m in _TOKEN.finditer(html):
        if m.start() > last:
            at.children.append(html[last : m.start()])
        last = m.end()
        end, tag = m.group(2), m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            if opened[tag]:
                up = at
                while up.tag != tag:
                    up = up.parent
                at = leave(up)
            continue
        closes = CLOSES.get(tag, ())
        if tag in _ENDS_P:
            closes = {*closes, "p"}
        while closes and at.stop.tag in closes:
            at = leave(at.stop)
        name = tag
        attrs = m.group(4)
        if attrs and "=" in attrs:
            style = sorted(f"{k.lower()}={_DIGITS.sub('#', a or b or c)}" for k, a, b, c in _STYLE.findall(attrs))
            if style:
                name = f"{tag} {' '.join(style)}"
        child = Node(tag, _key(at.key, name), at)
        if attrs and (tag == "a" or tag == "img"):
            link = _LINK.search(attrs)
            child.text = (link.group(1) or link.group(2) or link.group(3) or "") if link else ""
        at.children.append(child)
        if tag not in VOID and not attrs.endswith("/"):
            at = child
            opened[tag] += 1
    if last < len(html):
        at.children.append(html[last:])
    return root


def nodes(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag in DEAD:
            continue
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


_KINDS = "host string, node long, part int, kind byte, value long, n double, most double, features binary"


def _merged(key: np.ndarray, word: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of equal key and word added up, in order."""
    order = np.lexsort((word, key))
    key, word = key[order], word[order]
    head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (word[1:] != word[:-1]))) if len(key) else np.zeros(0, np.int64)
    if not len(head):
        return key, word, n, weight
    return key[head], word[head], np.add.reduceat(n[order], head), np.add.reduceat(weight[order], head)


def _pack(word: np.ndarray, n: np.ndarray, weight: np.ndarray) -> bytes:
    """Features in order of their hash; counts and weights only of those that aren't there once."""
    more = np.flatnonzero(n > 1).astype(np.uint32)
    raw = np.array([len(word), len(more)], np.uint32).tobytes() + np.diff(word, prepend=np.uint32(0)).astype(np.uint32).tobytes() + more.tobytes() + n[more].astype(np.float32).tobytes() + weight[more].astype(np.float32).tobytes()
    return np.array([len(raw)], np.uint32).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(blob[4:], int(np.frombuffer(blob, np.uint32, 1)[0]), "zstd", asbytes=True)
    a, b = np.frombuffer(raw, np.uint32, 2).tolist()
    word = np.cumsum(np.frombuffer(raw, np.uint32, a, 8), dtype=np.uint32)
    more = np.frombuffer(raw, np.uint32, b, 8 + 4 * a)
    n, weight = np.ones(a), np.zeros(a)
    n[more] = np.frombuffer(raw, np.float32, b, 8 + 4 * (a + b))
    weight[more] = np.frombuffer(raw, np.float32, b, 8 + 4 * (a + 2 * b))
    return word, n, weight


def _counts(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Counts over the pages of a task: nodes' styles (kind 0), features of nodes with text of their own (kind 1, in
    PARTS rows by hash) and nodes' parents (kind 2). A feature with c occurrences in a page adds c to its count and
    c log c to its weight."""
    style: Counter = Counter()
    child: dict[tuple[str, int], int] = {}
    names: dict[tuple[str, int], int] = {}
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        rows: list[tuple] = [(h, k, 0, 0, v, float(n), float(tags), None) for (h, k, v, tags), n in style.items()]
        rows += [(h, k, 0, 2, p, 1.0, 0.0, None) for (h, k), p in child.items()]
        if held:
            key, word, n, weight = _merged(*(np.concatenate(x) for x in zip(*held)))
            own = list(names)
            part = key * PARTS + (word >> np.uint32(32 - 4)).astype(np.int64)
            edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(part)]):
                rows.append((*own[key[i]], int(part[i] % PARTS), 1, 0, 0.0, 0.0, _pack(word[i:j], n[i:j], weight[i:j])))
        signed = lambda k: k - (1 << 64) if k >= 1 << 63 else k
        columns = list(zip(*rows)) or [()] * 8
        types = (pa.string(), pa.int64(), pa.int32(), pa.int8(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        columns[1], columns[4] = [signed(k) for k in columns[1]], [signed(k) for k in columns[4]]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _KINDS.split(", ")])
        style.clear(), child.clear(), names.clear(), held.clear()
        return batch

    for b in slices(batches, "html", 1 << 22):
        texts: list[str] = []
        owners: list[int] = []
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            if not host or not html:
                continue
            seen: dict[int, tuple[list, list, int]] = {}
            for node in nodes(parse(html)):
                got = seen.setdefault(node.key, ([], [], node.parent.key if node.parent else 0))
                got[0].append(" ".join([c.tag for c in node.children if isinstance(c, Node) and c.tag not in DEAD]))
                own = " ".join([c for c in node.children if isinstance(c, str)])
                if node.text:
                    own += f" L{_hash(node.text)}"
                if own and not own.isspace():
                    got[1].append(own)
            for key, (tags, own, parent) in seen.items():
                style[host, key, _hash("|".join(tags)) & 0x7FFFFFFFFFFFFFFF, tags[0].count(" ") + bool(tags[0])] += 1
                child[host, key] = parent
                if own:
                    texts.append(" ".join(own))
                    owners.append(names.setdefault((host, key), len(names)))
        w = Words(pa.array(texts, pa.string()))
        if len(w.hash):
            # Occurrences of each word in each text, which is one page's node; then words of each node over pages.
            row, word = w.row, (w.hash >> U64(32)).astype(np.uint32)
            both = np.sort((row.astype(U64) << U64(32)) | word.astype(U64))
            head = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            c = np.diff(np.append(head, len(both))).astype(float)
            held.append(_merged(np.array(owners, np.int64)[(both[head] >> U64(32)).astype(np.int64)], (both[head] & U64(0xFFFFFFFF)).astype(np.uint32), c, c * np.log(c)))
        if sum(len(h[0]) for h in held) > most:
            yield out()
    if style:
        yield out()


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From counts sorted by host, node and part: what each part of a node adds to its entropies."""
    current, styles, blobs = None, {}, []

    def out():
        host, node, _ = current
        pages = sum(n for n, _ in styles.values())
        looks = sum(n * np.log(n) for n, _ in styles.values())
        content = features = 0
        if blobs:
            word, n, weight = (np.concatenate(x) for x in zip(*map(_unpack, blobs)))
            _, word, n, weight = _merged(np.zeros(len(word), np.int64), word, n, weight)
            content, features = float((np.log(n) - weight / n).sum()), len(word)
        return (host, node, float(pages), float(looks), max((t for _, t in styles.values()), default=0.0), content, features, parent)

    rows, parent = [], None
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("host", "node", "part", "kind", "value", "n", "most", "features"))):
            if r[:3] != current:
                if current:
                    rows.append(out())
                current, styles, blobs, parent = r[:3], {}, [], None
            if r[3] == 0:
                n, tags = styles.get(r[4], (0.0, 0.0))
                styles[r[4]] = (n + r[5], max(tags, r[6]))
            elif r[3] == 1:
                blobs.append(r[7])
            else:
                parent = r[4]
    if current:
        rows.append(out())
    if rows:
        types = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["host", "node", "pages", "styles", "tags", "content", "features", "parent"])


def low_nodes(pages: DataFrame) -> DataFrame:
    """``host, drop``: the nodes of low importance of each host's style tree, from all of its pages."""
    raw = pages.mapInArrow(_counts, _KINDS).repartition("host", "node", "part").sortWithinPartitions("host", "node", "part")
    each = raw.mapInArrow(_nodes, "host string, node long, pages double, styles double, tags double, content double, features long, parent long")
    node = each.groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in ("pages", "styles", "content", "features")), F.max("tags").alias("tags"), F.max("parent").alias("parent"))
    return node.repartition("host").sortWithinPartitions("host").mapInArrow(_by_host, "host string, drop array<long>")


def _by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From nodes sorted by host: the nodes to remove of each host."""
    host, rows = None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([host]), pa.array([low_branches(rows)], pa.list_(pa.int64()))], ["host", "drop"])

    for b in batches:
        for r in b.to_pylist():
            if r["host"] != host and rows:
                yield out()
                rows = []
            host = r["host"]
            rows.append(r)
    if rows:
        yield out()


def importances(rows: list[dict]) -> dict[int, float]:
    """The composite importance of each node of one host's tree."""
    by, children = {r["node"]: r for r in rows}, defaultdict(list)
    for r in rows:
        children[r["parent"]].append(r["node"])
    order, stack = [], [r["node"] for r in rows if r["parent"] not in by]
    while stack:
        k = stack.pop()
        order.append(k)
        stack += children[k]
    score: dict[int, float] = {}
    weight: dict[int, float] = {}
    for k in reversed(order):
        r = by[k]
        m = r["pages"] or 1
        base = np.log(m) if m > 1 else 1.0
        look = 1.0 if m <= 1 else (np.log(m) - (r["styles"] or 0) / m) / base
        features = r["features"] or 0
        own = 1.0 if m <= 1 or not features else 1 - min(1.0, max(0.0, (r["content"] or 0) / features / base))
        parts = [(weight[c], score[c]) for c in children[k]]
        if features:
            parts.append((features, own))
        total = sum(w for w, _ in parts)
        l = r["tags"] or 0  # noqa: E741
        inner = sum(w * s for w, s in parts) / total if total else 0.0
        score[k] = own if not children[k] else (1 - GAMMA**l) * max(0.0, look) + GAMMA**l * inner
        weight[k] = total
        if not children[k] and not features:
            score[k] = 0.0
    return score


def low_branches(rows: list[dict]) -> list[int]:
    """The roots of branches in which no node reaches the least importance; none on a single page, where that is 0. ``html`` and ``body`` stay."""
    pages = max((r["pages"] or 0 for r in rows), default=1)
    parent = {r["node"]: r["parent"] for r in rows}
    signed = lambda k: k - (1 << 64) if k >= 1 << 63 else k
    good = {signed(k) for k in (1, _key(1, "html"), _key(_key(1, "html"), "body"))}
    score = importances(rows)
    main = max(rows, key=lambda r: (r["features"] or 0, r["node"]))["node"]
    least = (1 - FACTOR * (1 - score[main])) * (1 - 1 / max(1, pages))
    for k, s in score.items():
        while s >= least and k in parent and k not in good:
            good.add(k)
            k = parent[k]
    return sorted(k for k in parent if k not in good and (parent[k] in good or parent[k] not in parent))


def content(html: str | None, drop: frozenset[int] | set[int]) -> str:
    """The text of a page without the branches to remove: a line for each block, entities resolved, spaces single."""
    if not html:
        return ""
    out: list[str] = []
    signed = lambda k: k - (1 << 64) if k >= 1 << 63 else k
    stack: list = [parse(html)]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag in DEAD or signed(x.key) in drop:
            continue
        if x.tag in BLOCKS:
            out.append("\n")
            stack.append("\n")
        stack.extend(reversed(x.children))
    text = entities.unescape("".join(c if c == "\n" else c.replace("\n", " ") for c in out))
    return "\n".join(line for line in (" ".join(x.split()) for x in text.split("\n")) if line)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html", 1 << 22):
        known: dict[str | None, set[int]] = {}
        texts = []
        for host, html, drop in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("drop")):
            if host not in known:
                known[host] = set(drop.as_py() or ())
            texts.append(content(html, known[host]))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), pa.array(texts, pa.string())], ["page_id", "host", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, host, text`` of each page: its text without the branches that its host's style tree finds low.

    The only page of a host, and pages without a host (null, empty or malformed URLs), lose only scripts, styles and the
    like. A null or empty page has an empty text. Rows with a null id stay; repeated rows give repeated results and
    count as pages each. Pages are read whole, whatever their length. Other columns don't matter; an empty table gives
    an empty result. Of nodes with equally many features the one with the greater key is the main content.
    """
    documents(pages.withColumn("doc_id", F.lit(1)), "doc_id")  # sets the size of batches
    host = F.nullif(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit(""))
    rows = pages.select("page_id", host.alias("host"), "html")
    table = cut(low_nodes(rows.where("host is not null").select("host", "html")))
    size = table.agg(F.sum(F.octet_length("host") + 8 * F.size("drop") + 32)).first()[0] or 0
    if size <= SENT:  # else pages and trees meet by host, where Spark parts the hosts of many pages
        table = F.broadcast(table)
    return rows.join(table, "host", "left").mapInArrow(_extract, "page_id long, host string, text string")
