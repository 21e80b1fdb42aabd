"""Main text of pages by site style trees.

The DOMs of a host are merged into one tree, whose nodes are elements by tag and names below
their parent's node; the texts of an element are a leaf of its own. A leaf's importance is one
minus the mean entropy of its texts over the pages that have it, each weighed by its words and
pages. An element's importance is composed bottom-up: the entropy of its styles (which elements
it holds) over its pages, and, more the fewer styles it has, its children's importance. A branch
whose importance is low goes whole, unless a node in it that enough pages have isn't low; of
other low leaves the texts that repeat go. What is low is told by the site itself: by comparison
with a leaf of main text that holds many words, so a site of copies loses nothing.

What pages say of themselves comes first: elements of noise (nav, footer, names, labels of
comments) go, and where landmarks (article, main) hold text only they stay. Forms, names in
doubt within landmarks and several articles are decided by their share of the page's words. Within landmarks no
branch goes by its importance: what a host's articles share, as headings, is their text too.

Every page is parsed once; nodes and texts travel as 8-byte hashes that are summed before they
are shuffled. Html and texts are never shuffled unless what goes is too much to send to each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side
from .dom import NOISE, Block, Page, child_key, parse

#: Pages a node must be on before its entropy says anything.
LEAST_PAGES = 8
#: Kinds of features.
TEXT, STYLE, NODE = 0, 1, 2
#: Share of an element's own importance that each of its styles takes from its children's.
DAMPING = 0.9
#: A node is low if its importance is below 1 by more than RATIO times what the reference is, and MARGIN.
RATIO, MARGIN = 2.0, 0.08
#: Share of a site's words that a reference must have.
MAIN_SHARE = 0.05
#: Importance below which a low branch goes whole.
LOW = 0.35
#: Keys of what goes that may be sent to every task (8 bytes each).
MOST_GONE = 1_000_000
#: A node's share of its parent on a page is counted in parts of this.
_PARTS = 1 << 20
#: Pages that a task hands on at a time.
_PAGES = 256
_FEATURES = "array<struct<node:bigint,kind:bigint,feature:bigint,weight:bigint,kept:boolean,chain:array<bigint>>>"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def text_hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def site_key(host: str) -> int:
    return xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))


def by_elements(page: Page) -> list[Block]:
    """Blocks that no noise element holds; if landmarks hold any of them, only those.

    Blocks in doubt go if others are left: where landmarks are all in doubt, what no doubt is
    about stays beside them, since either may be the main text.
    """
    blocks = [b for b in page.blocks if b.noise < NOISE]
    sure = [b for b in blocks if not b.noise]
    return [b for b in sure if b.content] or [b for b in blocks if b.content or not b.noise] or blocks


class _Tree:
    """The part of its site's tree that a page shows: nodes with text below them, by key."""

    def __init__(self, page: Page) -> None:
        self.page = page
        self.leaves: dict[int, int] = {}  # node position: key of its leaf
        self.children: dict[int, set[int]] = {}  # node key: keys of those with text
        self.chains: dict[int, list[int]] = {}  # key: keys from the root down to it
        keys, parents = page.keys, page.parents
        for at in dict.fromkeys(b.node for b in page.blocks):
            leaf = self.leaves[at] = child_key(keys[at], "#text")
            below, k = leaf, at
            while True:  # up to where this page's texts have led before
                known = keys[k] in self.children
                self.children.setdefault(keys[k], set()).add(below)
                if known or parents[k] < 0:
                    break
                below, k = keys[k], parents[k]
            path: list[int] = []
            while at >= 0 and keys[at] not in self.chains:
                path.append(at)
                at = parents[at]
            for k in reversed(path):
                self.chains[keys[k]] = [*self.chains.get(keys[parents[k]], []), keys[k]] if parents[k] >= 0 else [keys[k]]

    def features(self) -> list[tuple]:
        """(node, kind, feature, weight, kept, chain), each once a page.

        NODE: a node's parent (0: none) and share of it, with its chain; TEXT: a leaf's text and
        its words; STYLE: the styles of an element.
        """
        page, s = self.page, _signed
        kept = {b.node for b in by_elements(page)}
        out: list[tuple] = []
        leaf_kept: dict[int, bool] = {}
        for at, leaf in self.leaves.items():
            leaf_kept[leaf] = leaf_kept.get(leaf, False) or at in kept
            self.chains.setdefault(leaf, [*self.chains[page.keys[at]], leaf])
        share = {c: (parent, _PARTS // len(below)) for parent, below in self.children.items() for c in below}
        for key, chain in self.chains.items():
            parent, part = share.get(key, (0, _PARTS))
            out.append((s(key), NODE, s(parent), part, leaf_kept.get(key, False), [s(c) for c in chain]))
        texts = {(self.leaves[b.node], b.text) for b in page.blocks}
        out += [(s(leaf), TEXT, text_hash(t), t.count(" ") + 1, False, None) for leaf, t in texts]
        styles: dict[int, set[str]] = {}
        for at, style in page.styles:
            if page.keys[at] in self.children:
                styles.setdefault(page.keys[at], set()).add(style)
        out += [(s(key), STYLE, text_hash("\x00".join(sorted(found))), 1, False, None) for key, found in styles.items()]
        return out


def _lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([v for one in values for v in one], kind))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: page_id, url, its blocks that elements leave, and its features.

    Of blocks: texts, leaf (key of the tree), hash (of the text), fixed (within a landmark).
    """
    kinds = {"leaf": pa.int64(), "hash": pa.int64(), "fixed": pa.bool_(), "texts": pa.string()}

    def one(url: str | None, html: str | None) -> tuple[list[Block], _Tree]:
        page = parse(html, site_key(host_of(url)))
        return by_elements(page), _Tree(page)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _PAGES):
                b = whole.slice(at, _PAGES)
                rows = [one(u.as_py(), h.as_py()) for u, h in zip(b.column(1), b.column(2))]
                blocks = {
                    "leaf": [[_signed(t.leaves[x.node]) for x in found] for found, t in rows],
                    "hash": [[text_hash(x.text) for x in found] for found, _ in rows],
                    "fixed": [[x.content for x in found] for found, _ in rows],
                    "texts": [[x.text for x in found] for found, _ in rows],
                }
                features = [t.features() for _, t in rows]
                columns = list(zip(*(f for one in features for f in one))) or [[]] * 6
                types = [*[pa.int64()] * 4, pa.bool_(), pa.list_(pa.int64())]
                flat = [pa.array(c, k) for c, k in zip(columns, types)]
                ends = np.cumsum([0, *map(len, features)], dtype=np.int32)
                struct = pa.StructArray.from_arrays(flat, names=["node", "kind", "feature", "weight", "kept", "chain"])
                lists = [_lists(blocks[n], k) for n, k in kinds.items()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), *lists, pa.ListArray.from_arrays(pa.array(ends), struct)],
                    names=["page_id", "url", *kinds, "features"],
                )

    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    kind = rows.schema["page_id"].dataType.simpleString()
    lists = "leaf array<bigint>, hash array<bigint>, fixed array<boolean>, texts array<string>"
    return rows.mapInArrow(each, f"page_id {kind}, url string, {lists}, features {_FEATURES}")


def page_features(pages: DataFrame) -> DataFrame:
    """node, kind, feature, n (pages that have it), weight (their sum), kept, chain of what parsed found."""
    f = pages.select(F.explode("features").alias("f")).select("f.*")
    return f.groupBy("node", "kind", "feature").agg(
        F.count("*").alias("n"), F.sum("weight").alias("weight"), F.max("kept").alias("kept"),
        F.any_value("chain", ignoreNulls=True).alias("chain"),
    )


def tree_nodes(features: DataFrame) -> DataFrame:
    """One row per node: node, parent, chain, pages, share of its parent, kept, words, styles, own.

    own is the importance of a leaf, or that of an element by its styles alone.
    """

    def total(kind: int, value: Column | str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value))

    sums = features.groupBy("node").agg(
        F.max(F.when(F.col("kind") == NODE, F.col("feature"))).alias("parent"),
        F.any_value("chain", ignoreNulls=True).alias("chain"),
        total(NODE, F.col("n")).alias("pages"),
        total(NODE, F.col("weight")).alias("part"),
        total(TEXT, F.col("weight")).alias("words"),
        total(TEXT, F.col("weight") * F.log("n")).alias("text_log"),
        F.count_if(F.col("kind") == STYLE).alias("styles"),
        total(STYLE, F.col("n")).alias("styled"),
        total(STYLE, F.col("n") * F.log("n")).alias("style_log"),
        F.max("kept").alias("kept"),
    )
    m, s = F.col("pages"), F.col("styled")
    text = F.when(m > 1, 1 - F.col("text_log") / F.col("words") / F.log(m)).otherwise(1.0)
    # an element that holds nothing but text has that as its one style
    style = F.when(m == 1, 1.0).when(s > 1, (F.log(s) - F.col("style_log") / s) / F.log(s)).otherwise(0.0)
    own = F.when(F.col("words").isNotNull(), text).otherwise(style)
    return sums.select("node", "parent", "chain", "pages", "part", "kept", "words", "styles", own.alias("own"))


def style_trees(nodes: DataFrame) -> DataFrame:
    """tree_nodes with importance, composed of each node's own and its children's.

    An element with l styles has (1 - DAMPING**l) of its own and DAMPING**l of the mean of its
    children over its pages. So a node adds to each node above it the product of the shares
    between them, and one sum by ancestors does for all levels. nodes should be cut.
    """
    leaf = F.col("words").isNotNull()
    keep = F.when(leaf, 0.0).otherwise(F.pow(F.lit(DAMPING), F.greatest("styles", F.lit(1))))
    up = nodes.select(F.col("node").alias("parent"), F.col("pages").alias("__pages"), keep.alias("__keep"))
    factor = F.log(F.col("__keep") * F.col("part") / _PARTS / F.col("__pages"))
    factors = nodes.join(up, "parent").select(F.col("node").alias("at"), factor.alias("factor"))
    steps = nodes.select("node", F.posexplode("chain").alias("k", "at")).join(factors, "at")
    logs = F.transform(F.sort_array(F.collect_list(F.struct("k", "factor"))), lambda x: x["factor"])
    paths = steps.groupBy("node").agg(logs.alias("logs"))  # of at most MOST_DEPTH + 1
    added = nodes.join(paths, "node", "left").select(
        "chain", F.coalesce("logs", F.array().cast("array<double>")).alias("logs"), ((1 - keep) * F.col("own")).alias("value")
    )
    each = added.select(F.posexplode("chain").alias("k", "node"), "logs", "value")
    below = F.expr("aggregate(slice(logs, k + 1, size(logs)), 0D, (s, x) -> s + x)")
    found = each.groupBy("node").agg(F.round(F.sum(F.col("value") * F.exp(below)), 9).alias("importance"))
    return nodes.join(found, "node")


def low_nodes(trees: DataFrame) -> DataFrame:
    """trees with limit (of the site, null if it has no main text on enough pages), known, low.

    A site's reference is the leaf of most words among those that elements leave; if that is
    below LOW itself, the most important leaf that has MAIN_SHARE of those words.
    """
    site, known = F.element_at("chain", 1), F.col("pages") >= LEAST_PAGES
    main = trees.where(known & F.col("kept") & F.col("words").isNotNull()).select(site.alias("site"), "node", "words", "importance")
    totals = main.groupBy("site").agg(F.sum("words").alias("total"), F.max_by("importance", F.struct("words", "node")).alias("first"))
    shares = main.join(totals, "site").where(F.col("words") >= MAIN_SHARE * F.col("total"))
    best = shares.groupBy("site").agg(F.max("importance").alias("best"), F.max("first").alias("first"))
    reference = F.when(F.col("first") >= LOW, F.col("first")).otherwise(F.col("best"))
    limits = best.select("site", (RATIO * (1 - reference) + MARGIN).alias("limit"))
    out = trees.withColumn("site", site).join(limits, "site", "left").withColumn("known", known)
    return out.withColumn("low", F.coalesce(known & (1 - F.col("importance") > F.col("limit")), F.lit(False)))


def whole_branches(marked: DataFrame) -> DataFrame:
    """node of every branch of low_nodes that goes whole."""
    fine = F.col("known") & ~F.col("low")
    held = marked.select(F.explode("chain").alias("node"), fine.alias("fine")).groupBy("node").agg(F.max("fine").alias("fine"))
    lows = marked.where(F.col("low") & (F.col("importance") < LOW)).select("node")
    return lows.join(held.where(~F.col("fine")), "node", "left_semi")


def gone_keys(features: DataFrame) -> DataFrame:
    """key of what goes: leaves in whole branches, and (leaf xor text) of repeated texts of low leaves."""
    marked = cut(low_nodes(style_trees(cut(tree_nodes(features), "tree-nodes"))), "style-trees")
    whole = small_side(cut(whole_branches(marked), "whole-branches"))
    leaves = marked.where(F.col("words").isNotNull())
    steps = leaves.select(F.col("node").alias("key"), F.explode("chain").alias("node"))
    in_whole = cut(steps.join(whole, "node", "left_semi").select("key").distinct(), "gone-leaves")
    others = leaves.where("low").join(small_side(in_whole), F.col("node") == F.col("key"), "left_anti")
    texts = features.where(F.col("kind") == TEXT).select("node", "feature", "n")
    found = texts.join(small_side(cut(others.select("node", "pages", "limit"), "low-leaves")), "node")
    repeated = found.where(F.log("n") / F.log("pages") > F.col("limit"))
    return in_whole.unionByName(repeated.select(F.col("node").bitwiseXOR(F.col("feature")).alias("key"))).distinct()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    Null or empty html gives an empty text; pages without a host form one site. Blocks are
    joined by a line feed, white space inside one is one space. Rows may repeat, and ids may be
    null; an empty table gives no rows; other columns are ignored. A page all of whose blocks
    go has an empty text.
    """
    found = cut(parsed(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id()), "parsed-pages")
    gone = cut(gone_keys(cut(page_features(found), "page-features")), "gone-keys")
    few = gone.limit(MOST_GONE + 1).count() <= MOST_GONE
    sent = np.sort(np.array([r[0] for r in gone.collect()], np.int64)) if few else None
    rows = found.select("page_id", "url", "leaf", "hash", "fixed", "texts", "row")
    if not few:  # each page gets its own keys, by the number of its row
        keys = F.array_union("leaf", F.zip_with("leaf", "hash", lambda a, b: a.bitwiseXOR(b)))
        own = rows.select(F.col("row").alias("r"), F.explode(keys).alias("key")).join(gone, "key", "left_semi")
        own = own.groupBy("r").agg(F.collect_set("key").alias("own"))
        rows = rows.join(own, F.col("row") == F.col("r"), "left").drop("r")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, text, fixed = (np.asarray(b.column(k).flatten()) for k in (2, 3, 4))
            counts = pc.list_value_length(b.column(2)).to_numpy()
            if sent is not None:
                goes = np.isin(leaf, sent) | np.isin(leaf ^ text, sent)
            else:
                own = pc.list_value_length(b.column(7)).fill_null(0).to_numpy()
                mine = list(zip(np.repeat(np.arange(len(own)), own).tolist(), np.asarray(b.column(7).flatten()).tolist()))
                at, known = np.repeat(np.arange(len(counts)), counts).tolist(), set(mine)
                goes = np.array([(r, x) in known or (r, y) in known for r, x, y in zip(at, leaf.tolist(), (leaf ^ text).tolist())], bool)
            stays = fixed.astype(bool) | ~goes
            ends = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], np.cumsum(counts)])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), b.column(5).flatten().filter(pa.array(stays)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.binary_join(lists, "\n")], names=["page_id", "url", "text"])

    schema = found.select("page_id", "url").schema.add("text", "string")
    return rows.mapInArrow(texts, schema).withColumn("n_chars", F.length("text").cast("long"))
