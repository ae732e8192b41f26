"""Similarity join of documents on the Jaccard index of their word n-grams.

Equal sets are one class from the start, so copies are never expanded. Classes meet by
MinHash banding: the numbers of bands and rows follow from the similarity and the target
recall, and every class is shuffled once per band under the band's hash. Classes that share
a hash are tied to the smallest of them, and the components of these ties are clusters: two
classes that meet in any band are in one cluster. Within a cluster every pair with a common
n-gram is then verified on the full sets, by counting common n-grams over posting lists in
memory: the links are exact, no row is ever made for a pair, and all that leaves a task is
each class's number of links and a spanning forest. A large cluster is cut into blocks of
bounded size, and each pair of blocks is a task. What banding may miss is bounded by the
target recall. Groups are connected components of links.

Words are runs of visible characters; a text of fewer words than an n-gram is one n-gram.
A set is named by 64 bits of its hash.

Defined results: a null or wordless text has no n-grams, is linked to nothing and is its
own class; repeated rows are copies; a null id stays null and takes part like any other row;
texts of any length take part with all their n-grams; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import map_batches, stored, texts

WORDS, SIMILARITY = 5, 0.8
#: Share of links at exactly the wanted similarity that banding must find, and hash rows allowed.
RECALL, MOST_ROWS = 0.9999, 300
#: N-grams and classes in one block of a cluster, about. Near copies share their posting lists, so
#: the work of a pair of blocks grows with the product of their classes.
BLOCK_GRAMS, BLOCK_CLASSES = 1_000_000, 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_ROWS) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach the recall within ``most`` hashes."""
    for rows in range(most, 0, -1):
        hit = similarity ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit > 1e-9 else most + 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands reach the recall with so few hashes")


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngram_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    from xxhash import xxh64_intdigest

    items = text.encode().split()
    if not items:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxh64_intdigest, items), dtype=np.uint64, count=len(items))
    width = min(words, len(items))
    count = len(items) - width + 1
    total = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        total = mix(total * _STEP + each[k:k + count])
    return np.unique(total)


def set_name(grams: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(grams.tobytes()) - (1 << 63)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band over its rows' minima."""
    points = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    random = np.random.default_rng(20_231)
    factor = (random.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1))[:, None]
    shift = random.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]
    least = np.full(bands * rows, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(points), 1024):
        np.minimum(least, (points[None, start:start + 1024] * factor + shift).min(axis=1), out=least)
    least = least.reshape(bands, rows).astype(np.uint64)
    total = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        total = mix(total * _STEP + least[:, k])
    return total.view(np.int64)


def text_key() -> Column:
    """64 bits of a text's hash; with the id it finds a row again."""
    return F.xxhash64(F.col("text").cast("string"))


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, node, n, bands): the key of every document's text, the name and size of its set
    and its band hashes."""
    ids = ["doc_id", "key"]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sizes, hashes = [], [], []
            known: dict[int, np.ndarray] = {}
            for text in texts(batch):
                grams = ngram_set(text, words)
                sizes.append(len(grams))
                node = set_name(grams) if len(grams) else None
                nodes.append(node)
                if node is not None and node not in known:
                    known[node] = band_hashes(grams, bands, rows)
                hashes.append(known.get(node))
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ids), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array(hashes, pa.list_(pa.int64()))], [*ids, "node", "n", "bands"])
        return work
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         text_key().alias("key"))
    return map_batches(source, "doc_id long, key long, node long, n int, bands array<long>", make)


def ties(classes: DataFrame) -> DataFrame:
    """Distinct (a, b): every class with the smallest class under one of its band hashes."""
    banded = classes.select(F.explode("bands").alias("band"), "node")
    shared = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    return (
        banded.join(shared, "band").where(F.col("node") != F.col("least"))
        .select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    )


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, grams) of the wanted (node, first), by the id and the key of the text of their first rows."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sets = [], []
            for text, node in zip(texts(batch), batch.column("node").to_pylist()):
                grams = ngram_set(text, words)
                if len(grams) and set_name(grams) == node:
                    nodes.append(node)
                    sets.append(grams.view(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "grams"])
        return work
    source = docs.select(F.col("doc_id").cast("long").alias("own_id"), text_key().alias("own_key"), F.col("text").cast("string").alias("text"))
    # Only rows of one id and one text meet their class, however many rows have no id or the same.
    picked = source.join(wanted, source["own_id"].eqNullSafe(wanted["first.doc_id"]) & (source["own_key"] == wanted["first.key"])).select(
        "text", "node")
    return map_batches(picked, "node long, grams array<long>", make).dropDuplicates(["node"])


class Block:
    """Posting lists over the n-grams of some classes, for counting common n-grams."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], dtype=np.int64)
        self.kinds, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(ids, kind="stable")]
        self.count = np.bincount(ids, minlength=len(self.kinds))
        self.start = np.cumsum(self.count) - self.count

    def common(self, grams: np.ndarray) -> np.ndarray:
        """Number of n-grams that each class of the block has in common with ``grams``."""
        at = np.minimum(np.searchsorted(self.kinds, grams), len(self.kinds) - 1)
        at = at[self.kinds[at] == grams]
        count = self.count[at]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(self.start[at] - (ends - count), count)
        return np.bincount(self.owners[places], minlength=len(self.sizes))


def linked_in(nodes: list[int], members: list[int], sets: list[np.ndarray], first: list[bool], same: bool,
              similarity: float) -> list[tuple[int, int, int]]:
    """(node, linked documents, smallest node reached) of the classes with a link between the two
    blocks, of which ``first`` marks the one; ``same``: there is one block, compared with itself."""
    left = [k for k, f in enumerate(first) if f]
    right = left if same else [k for k, f in enumerate(first) if not f]
    if not left or not right:
        return []
    block = Block([sets[k] for k in right])
    right_at, weight = np.array(right), np.array(members, dtype=np.int64)
    more = np.zeros(len(nodes), dtype=np.int64)
    root = list(range(len(nodes)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in left:
        common = block.common(sets[k])
        near = right_at[common >= similarity * (len(sets[k]) + block.sizes - common) - 1e-9]
        near = near[near > k] if same else near
        if len(near):
            more[k] += weight[near].sum()
            more[near] += weight[k]
            for j in near.tolist():
                a, b = find(k), find(j)
                if a != b:
                    low, high = (a, b) if nodes[a] < nodes[b] else (b, a)
                    root[high] = low
    return [(nodes[k], int(more[k]), nodes[find(k)]) for k in np.flatnonzero(more).tolist()]


def links(sets: DataFrame, clusters: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(node, more, root): per class and task the number of linked documents of other classes and
    the smallest class reached by links."""
    sized = clusters.join(classes.select("node", "members", "n"), "node")
    blocks = sized.groupBy("label").agg(F.ceil(F.greatest(
        F.sum("n") / BLOCK_GRAMS, F.count(F.lit(1)) / BLOCK_CLASSES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        sets.join(sized.join(blocks, "label").withColumn("own", own), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                (F.col("own") <= F.col("other")).alias("first"), "node", "members", "grams")
        .repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def result() -> pa.RecordBatch:
            nodes, members, grams, first = map(list, zip(*rows)) if rows else ([], [], [], [])
            found = linked_in(nodes, members, grams, first, bool(now) and now[1] == now[2], similarity)
            columns = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "more", "root"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("label", "i", "j")))
            rest = zip(*(batch.column(c).to_pylist() for c in ("node", "members", "first")))
            for k, (key, (node, members, first)) in enumerate(zip(keys, rest)):
                if key != now:
                    yield result()
                    now, rows = key, []
                rows.append((node, members, batch.column("grams")[k].values.to_numpy().view(np.uint64), first))
        yield result()

    return dealt.mapInArrow(run, "node long, more long, root long")


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of (a, b), by the smallest
    neighbouring label and by jumping to the label's own label, until nothing changes."""
    edges = stored(
        pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        .select("node", F.least("node", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        near = (
            edges.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = F.least("label", "near", "far")
        labels = stored(
            labels.join(near, "node").join(far, "label")
            .select("node", new.alias("label"), (new < F.col("label")).alias("moved")), "labels")
    return labels.select("node", "label")


class Join:
    """The parts of one similarity join: signatures, classes and links. A class's first row is
    that of the smallest id (null last), then of the smallest key of the text."""

    def __init__(self, docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY,
                 recall: float = RECALL, most_rows: int = MOST_ROWS):
        bands, rows = choose_bands(similarity, recall, most_rows)
        self.signatures = stored(signatures(docs, words, bands, rows), "signatures")
        # Equal sets have equal sizes and band hashes, so any row's stand for the class.
        self.classes = stored(
            self.signatures.where(F.col("node").isNotNull()).groupBy("node").agg(
                F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"),
                F.first("n").alias("n"), F.first("bands").alias("bands"),
                F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")), "classes")
        clusters = components(stored(ties(self.classes), "ties"))
        wanted = self.classes.select("first", "node").join(clusters, "node", "left_semi")
        self.links = stored(links(full_sets(docs, wanted, words), clusters, self.classes, similarity), "links")

    def labelled(self, *columns: str) -> DataFrame:
        """(node, columns, label): the classes, each with the smallest node of its group."""
        # A class that met several blocks has a root from each. It is tied to the least of them, and so are
        # the other roots, which the classes of a block share: a row per class, and few more.
        least = F.min("root").over(Window.partitionBy("node"))
        roots = self.links.where("node != root").select("node", "root", least.alias("least"))
        pairs = roots.select(F.explode(F.array(F.col("node"), F.col("root"))).alias("a"), F.col("least").alias("b"))
        label = components(pairs.where("a != b").distinct())
        return self.classes.select("node", *columns).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def documents(self) -> DataFrame:
        """(doc_id, class_id, n_links, set_id): the smallest id of each document's group, how many
        other documents it is linked to, and the smallest id with the same set of n-grams."""
        linked = self.links.groupBy("node").agg(F.sum("more").alias("more"))
        named = self.labelled("rep", "members").join(linked, "node", "left")
        groups = named.groupBy("label").agg(F.min("rep").alias("class_id"))
        classes = named.join(groups, "label").select(
            "node", "class_id", F.col("rep").alias("set_id"),
            (F.col("members") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
        return self.signatures.select("doc_id", "node").join(classes, "node", "left").select(
            "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"))


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, class_id, n_links, set_id) of every document."""
    return Join(docs, **parameters).documents()


def one_of_each_group(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, all columns as they are: one of each group of near copies, which is
    the one with the smallest id, or of rows that share it the one with the smallest key of its
    text. A null id comes after all others. Wordless documents stay. Rows that share id and text
    are one document; wordless rows without an id are not told apart and all stay."""
    chosen = (
        Join(docs, **parameters).labelled("first").groupBy("label").agg(F.min("first").alias("first"))
        .select("label", F.col("first.doc_id").alias("id"), F.col("first.key").alias("key"))
    )
    # Whole rows travel as one column, so no name of theirs can clash.
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), text_key().alias("own_key"))
    found = whole.join(chosen, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left")
    wordless = ~F.coalesce(F.col("row.text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = found.where(F.col("label").isNotNull() | wordless).select(
        "row", "label", F.when(F.col("label").isNull(), F.struct("own_id", F.col("row.text"))).alias("empty"),
        F.when(F.col("label").isNull() & F.col("own_id").isNull(), F.monotonically_increasing_id()).alias("lone"))
    order = [F.col(f"row.{c}") for c in docs.columns if c in ("lang", "source", "n_chars")] + [F.col("row").cast("string")]
    number = F.row_number().over(Window.partitionBy("label", "empty", "lone").orderBy(*order))
    return rows.withColumn("number", number).where("number = 1").select("row.*")
