"""N-gram Jaccard join by parity sketches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, stage
from .shingles import _runs_of, mix, plain_shingles, shingle_sets

WORDS_PER_SHINGLE = 5
#: The threshold as a ratio: 100 * intersection >= 80 * union.
LINK, OF = 80, 100
#: A band's largest set by its smallest.
BAND = 1.6
#: Sketch words beyond the differences of a pair, as a share of these, so that words of one shingle can be left out.
SPARE = 0.18
SEEDS = 8
#: Nodes that a task remembers so that copies' sketches aren't sent again.
REMEMBERED = 200_000
#: Keys that a task combines before it sends them.
FLUSH_KEYS = 1 << 20
#: Nodes up to which a cluster of candidates is compared block by block, and shingles of a block's nodes.
CLUSTER_NODES, BLOCK_SHINGLES = 32_768, 1_000_000
#: Blocks that a cluster is cut into where these aren't too small.
BLOCKS = 4
#: Candidate documents up to which their ids are broadcast to pick their texts; beyond it the texts are joined by shuffle.
BROADCAST_IDS = 250_000


@lru_cache(maxsize=1)
def _edges() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * BAND))))
    return out


def difference(a: int, b: int) -> int:
    """The largest symmetric difference of linked sets of ``a`` and ``b`` elements.

    With union u and difference d: u - d >= u * LINK / OF and a + b = 2u - d.
    """
    return (OF - LINK) * (a + b) // (OF + LINK)


def configs(n: int) -> list[tuple[int, int, int]]:
    """(band, words of the sketch, most words in which a linked set can differ) for the bands of ``n`` and its larger partners."""
    edges, out = _edges(), []
    own = int(np.searchsorted(edges, n, "right")) - 1
    for band in (own, own + 1):
        high, partner = edges[band + 1] - 1, n * OF // LINK
        if band > own and partner < edges[band]:
            break
        most = difference(high, high)
        if most:
            out.append((band, int(np.ceil((1 + SPARE) * (most + 1))) + 1, difference(n, min(partner, high))))
    return out


def sketch_keys(tokens: np.ndarray) -> np.ndarray:
    """Join keys of a set of token hashes: any two linked, unequal sets have one in common.

    Per band, each token is XORed into one of P words. A token on one side alone changes one word, so the
    number of differing words is at most the symmetric difference, and with P beyond it some words are equal.
    Words of less than two tokens say little and give no key; where a sketch has so many of them that the equal
    words might all be such, the next seed's sketch is sent as well, and after the last seed every token.
    Of two sets, the keys of the first seed at which one isn't short of words meet: the other sends that seed too.
    """
    out = []
    n = len(tokens)
    for band, words, most in configs(n):
        for seed in range(SEEDS):
            salt = np.uint64((band * 64 + seed + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
            part = (((mix(tokens ^ salt) >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)).astype(np.int64)
            held = np.bincount(part, minlength=words)
            order = np.argsort(part, kind="stable")
            (filled,) = held.nonzero()
            first = np.concatenate(([0], np.cumsum(held[filled])[:-1]))
            value = np.bitwise_xor.reduceat(tokens[order], first)
            good = held[filled] >= 2
            out.append(mix(value[good] ^ mix(filled[good].astype(np.uint64) + salt)))
            if int(good.sum()) > most:
                break
        else:
            out.append(mix(tokens ^ np.uint64(band * 64 + 63)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def node_of(tokens: np.ndarray) -> int:
    """One number for a set: documents with equal sets are one node."""
    both = np.array([np.bitwise_xor.reduce(tokens), tokens.sum(dtype=np.uint64), len(tokens)], np.uint64)
    return int(mix(mix(mix(both[:1]) + both[1:2]) + both[2:]).view(np.int64)[0])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return OF * common >= LINK * (len(a) + len(b) - common)


def linked_words(a: str, b: str) -> bool:
    """Whether two texts link by their words themselves; asked of pairs that link by hashes."""
    x, y = plain_shingles(a, WORDS_PER_SHINGLE), plain_shingles(b, WORDS_PER_SHINGLE)
    common = len(x & y)
    return OF * common >= LINK * (len(x) + len(y) - common)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for batch in slices(whole, "text"):
            yield batch, shingle_sets(batch.column(batch.schema.get_field_index("text")), WORDS_PER_SHINGLE)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n_shingles", "node"])


def _keys(batches: Iterator[pa.RecordBatch], flush: int = FLUSH_KEYS) -> Iterator[pa.RecordBatch]:
    """Keys with their nodes, where a key's several nodes in a batch of ``flush`` keys are told apart already.

    The smallest of these is their hub, and it alone goes on with the key (hub null); so a key that a large part of all
    documents share reaches its one task once per batch.
    """
    seen: set[int] = set()
    held, n = [], 0
    for _, sets in _sets(batches):
        for s in sets:
            if not len(s) or (node := node_of(s)) in seen:
                continue
            if len(seen) < REMEMBERED:
                seen.add(node)
            keys = sketch_keys(s)
            held.append((keys.view(np.int64), np.full(len(keys), node, np.int64)))
            n += len(keys)
        if n >= flush:
            yield _combined(held)
            held, n = [], 0
    if held:
        yield _combined(held)


def _combined(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    key, node = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = _runs_of(key, node)
    key, node = key[new], node[new]
    (first,) = _runs_of(key).nonzero()
    hub = np.repeat(node[first], np.diff(np.append(first, len(key))))
    order = np.argsort(node, kind="stable")  # a node's rows together compress far better
    key, node, hub = key[order], node[order], hub[order]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(hub, mask=hub == node)], ["key", "node", "hub"])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts joined by id, those that are their node's."""
    for batch, sets in _sets(batches):
        right = [len(s) > 0 and node_of(s) == node for s, node in zip(sets, batch.column("node").to_pylist(), strict=True)]
        yield batch.select(["node", "text"]).filter(pa.array(right, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, kept = None, None
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingle_sets(batch.column("text"), WORDS_PER_SHINGLE)
            hubs, texts, keep = batch.column("a").to_pylist(), batch.column("hub_text"), []
            for i, hub in enumerate(hubs):
                if hub != last:
                    last, kept = hub, shingle_sets(texts.slice(i, 1), WORDS_PER_SHINGLE)[0]
                keep.append(linked(kept, sets[i]) and linked_words(texts[i].as_py(), batch.column("text")[i].as_py()))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def bit_sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Each token flips one of ``bits`` bits: the Hamming distance is at most the symmetric difference."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, tokens in zip(out, sets, strict=True):
        place = (mix(tokens + np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64)
        row[:] = np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).view(np.uint64)
    return out


def block_links(nodes: np.ndarray, sets: list[np.ndarray], other: np.ndarray, sure: Callable[[int, int], bool] = lambda i, j: True) -> list[tuple[int, int]]:
    """Links between nodes that join all that are linked within the block, or between its two sides.

    ``other`` tells the sides of a pair of blocks apart; with one side alone, all its pairs count. A pair is verified
    on its sets if its sizes allow a link, its sketches differ in no more bits than a link can, and other
    links haven't joined it yet; so a group of copies yields a link per member, not per pair. ``sure`` is asked last,
    with the pair's places.
    """
    size = np.array([len(x) for x in sets], np.int64)
    order = np.lexsort((nodes, size))
    nodes, size, other, sets = nodes[order], size[order], other[order], [sets[i] for i in order]
    bits = 1 << int(np.clip(np.ceil(np.log2(4 * np.median(size))), 8, 16))
    sketch, parent, out = bit_sketches(sets, bits), np.arange(len(sets)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    mixed = other.any() and not other.all()
    for i in range(len(sets)):
        end = int(np.searchsorted(size, size[i] * OF // LINK, "right"))
        if end <= i + 1:
            continue
        apart = np.bitwise_count(sketch[i + 1 : end] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        near = apart <= (OF - LINK) * (size[i + 1 : end] + size[i]) // (OF + LINK)
        if mixed:
            near &= other[i + 1 : end] != other[i]
        found = near.nonzero()[0]
        for j in (found[np.argsort(apart[found], kind="stable")] + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b and linked(sets[i], sets[j]) and sure(int(order[i]), int(order[j])):
                parent[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def block_counts(copies: np.ndarray, sets: list[np.ndarray], other: np.ndarray, within: bool) -> np.ndarray:
    """Per node the links between its copies and those of the larger nodes that it is linked with, all pairs verified.

    With ``within`` all pairs count, else those between the two sides that ``other`` tells apart.
    """
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, weight, side, sorted_sets = size[order], copies[order], other[order], [sets[i] for i in order]
    sketch = bit_sketches(sorted_sets, 1 << int(np.clip(np.ceil(np.log2(4 * np.median(size))), 8, 16)))
    out = np.zeros(len(sets), np.int64)
    for i in range(len(sets)):
        end = int(np.searchsorted(size, size[i] * OF // LINK, "right"))
        apart = np.bitwise_count(sketch[i + 1 : end] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        near = apart <= (OF - LINK) * (size[i + 1 : end] + size[i]) // (OF + LINK)
        if not within:
            near &= side[i + 1 : end] != side[i]
        out[order[i]] = weight[i] * sum(int(weight[j]) for j in (near.nonzero()[0] + i + 1).tolist() if linked(sorted_sets[i], sorted_sets[j]))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pair of blocks' nodes with their numbers of links in it; rows come sorted as for ``_blocks``."""
    key, held = None, ([], [], [], [])

    def done() -> pa.RecordBatch:
        found = block_counts(np.array(held[2], np.int64), held[1], np.array(held[3], bool), key[1] == key[2])
        return pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(found)], ["node", "n_links"])

    for batch, sets in _sets(batches):
        rows = zip(*(batch.column(c).to_pylist() for c in ("cluster", "x", "y", "node", "copies", "side")), sets, strict=True)
        for cluster, x, y, node, copies, side, tokens in rows:
            if (cluster, x, y) != key:
                if held[0]:
                    yield done()
                key, held = (cluster, x, y), ([], [], [], [])
            for part, value in zip(held, (node, tokens, copies, side), strict=True):
                part.append(value)
    if held[0]:
        yield done()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each pair of blocks; rows come sorted by cluster and pair, so that one pair at a time is held."""
    key, held = None, ([], [], [], [])

    def done() -> pa.RecordBatch:
        sure = lambda i, j: linked_words(held[3][i].as_py(), held[3][j].as_py())
        found = block_links(np.array(held[0], np.int64), held[1], np.array(held[2], bool), sure) if len(held[0]) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch, sets in _sets(batches):
        rows = zip(*(batch.column(c).to_pylist() for c in ("cluster", "x", "y", "node", "side")), sets, batch.column("text"), strict=True)
        for cluster, x, y, node, side, tokens, text in rows:
            if (cluster, x, y) != key:
                if held[0]:
                    yield done()
                key, held = (cluster, x, y), ([], [], [], [])
            for part, value in zip(held, (node, tokens, side, text), strict=True):
                part.append(value)
    if held[0]:
        yield done()


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the links (a, b) between nodes; labels are nodes, the smallest of a component.

    Links become links between labels. In each round every label hooks onto its smallest neighbour, chains are
    shortened by jumping, and links inside one component go; a round leaves at most half of the linked labels.
    """
    start = links
    for side in ("a", "b"):
        start = start.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")), side)
    open_ = stage(start.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a != b").distinct())
    while open_.limit(1).count():
        both = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stage(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("from"), F.least("a", "to").alias("to")))
        while True:
            onward = hooks.select(F.col("from").alias("to"), F.col("to").alias("next"))
            jumped = stage(hooks.join(onward, "to", "left").select("from", F.coalesce("next", "to").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            hooks = jumped.select("from", "to")
            if not jumped.where("moved").limit(1).count():
                break
        to = hooks.where("from != to")
        labels = stage(labels.join(to.withColumnRenamed("from", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        for side in ("a", "b"):
            open_ = open_.join(to.withColumnRenamed("from", side), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        open_ = stage(open_.where("a != b").distinct())
    return labels


def _dealt(placed: DataFrame, texts: DataFrame, block_shingles: int, *more: str) -> DataFrame:
    """The nodes (cluster, node, n and ``more``) with their texts for each pair of blocks of their cluster, sorted by these.

    Blocks by size of set from a histogram of sizes; many sets of one size are dealt over blocks by hash. A cluster of
    a tenth of ``block_shingles`` and more is cut into several blocks, so that its pairs aren't one task's.
    """
    smaller = Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("cluster", "n").agg(F.sum("n").alias("_w"))
    whole = F.sum("_w").over(Window.partitionBy("cluster"))
    sizes = sizes.withColumn("_block", F.least(F.lit(float(block_shingles)), F.greatest(whole / BLOCKS, F.lit(block_shingles / 10))))
    sizes = sizes.withColumn("_low", F.floor(F.coalesce(F.sum("_w").over(smaller), F.lit(0)) / F.col("_block")))
    own = F.col("_low") + F.pmod(F.xxhash64("node"), F.ceil(F.col("_w") / F.col("_block")))
    placed = placed.join(sizes, ["cluster", "n"]).select("cluster", "node", "n", own.alias("block"), *more)
    last = placed.groupBy("cluster").agg(F.max("block").alias("last"))
    dealt = placed.join(last, "cluster").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    pairs = dealt.select("cluster", "node", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), (F.col("block") > F.col("with")).alias("side"), *more).join(texts, "node")
    return pairs.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cluster_nodes: int = CLUSTER_NODES, block_shingles: int = BLOCK_SHINGLES, count_links: bool = False, flush_keys: int = FLUSH_KEYS) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included).

    Documents with equal shingle sets are one node. Nodes send the keys of their sketches (see ``sketch_keys``); nodes
    with a key in common are candidates of each other, and candidates of candidates a cluster, so that all links lie
    inside clusters. A cluster is cut into blocks of about ``block_shingles`` shingles by size of set, and each pair of
    blocks is compared by bit sketches and verified on the sets (see ``block_links``), a bounded task of its own.
    Clusters of more than ``cluster_nodes`` nodes, where such pairs would become many, go key by key instead (see
    ``_by_key``). No pair is left out on either way. Links between texts are confirmed on the words themselves; equal sets
    are told by 64-bit hashes. Sets, links and labels stay in tables; only counts come to the driver.

    With ``count_links`` the column n_links tells how many pairs of rows of the component are linked, copies included;
    every pair that the sketches allow is then verified, block by block in clusters of any size.

    Null and empty texts and those without words have n_shingles 0 and are linked with nothing. Repeated rows are
    equal sets; a null id joins its component but names it only if all ids there are null. Other columns are dropped.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = stage(rows.mapInArrow(_nodes, "doc_id long, n_shingles long, node long"))
    smallest = table.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"))

    in_key = Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    keys = rows.select("text").mapInArrow(partial(_keys, flush=flush_keys), "key long, node long, hub long")
    shared = stage(keys.withColumn("hub", F.coalesce("hub", F.first("node").over(in_key))).where("hub != node"))
    stars = stage(shared.groupBy("hub", "node").agg(F.count(F.lit(1)).alias("n")))
    involved = stage(stars.select("node").unionByName(stars.select(F.col("hub").alias("node"))).distinct().join(smallest, "node"))
    picked = involved.select("node", "doc_id")
    picked = F.broadcast(picked) if involved.count() <= BROADCAST_IDS else picked
    chosen = rows.withColumnRenamed("doc_id", "_d").join(picked, F.col("_d").eqNullSafe(F.col("doc_id"))).select("node", "text")
    texts = stage(chosen.mapInArrow(_rebuilt, "node long, text string").dropDuplicates(["node"]))

    alone = involved.select("node", F.col("node").alias("label"))
    clusters = merge_labels(alone, stars.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    large = stage(clusters.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > cluster_nodes).select("label"))
    placed = clusters.join(large, "label", "left_anti").withColumnRenamed("label", "cluster").join(involved.select("node", "n"), "node")
    links = _dealt(placed, texts, block_shingles).mapInArrow(_blocks, "a long, b long")
    labels = merge_labels(alone, stage(links))
    if large.limit(1).count():
        inside = clusters.join(large, "label").select("node")
        labels = _by_key(shared.join(inside, "node", "left_semi"), texts, labels)

    named = smallest.select("node", F.col("doc_id").alias("_low")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("_low").alias("component_id"))
    names = named.join(lowest, "label").select(F.col("node").alias("_n"), "component_id")
    empty = table.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = table.where("node is not null").join(names, F.col("node") == F.col("_n"), "left")
    if not count_links:
        return found.select("doc_id", "n_shingles", "component_id").unionByName(empty)
    copies = table.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    members = clusters.withColumnRenamed("label", "cluster").join(involved.select("node", "n"), "node").join(copies, "node")
    between = _dealt(members, texts, block_shingles, "copies").mapInArrow(_counts, "node long, n_links long")
    alike = copies.select("node", F.floor(F.col("copies") * (F.col("copies") - 1) / 2).alias("n_links"))
    sums = stage(alike.unionByName(between).join(named.select("node", "label"), "node").groupBy("label").agg(F.sum("n_links").alias("n_links")))
    counted = named.select("node", "label").join(sums, "label").select(F.col("node").alias("_c"), "n_links")
    whole = found.join(counted, F.col("node") == F.col("_c")).select("doc_id", "n_shingles", "component_id", "n_links")
    return whole.unionByName(empty.withColumn("n_links", F.lit(0).cast("long")))


def _by_key(shared: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` after all links between nodes of a key; ``shared`` has (key, hub, node), hubs smaller nodes of the key.

    Each node is verified against one hub, then against its other hubs as long as they are in other components; for
    keys whose nodes still lie in several components the pairs across these are verified. Pairs in one component
    can't change it.
    """
    stars = stage(shared.groupBy("hub", "node").agg(F.count(F.lit(1)).alias("n")))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) the links."""
        with_text = pairs.join(texts.select(F.col("node").alias("b"), "text"), "b")
        both = with_text.join(texts.select(F.col("node").alias("a"), F.col("text").alias("hub_text")), "a")
        return stage(both.select("a", "b", "hub_text", "text").mapInArrow(_verify, "a long, b long"))

    def across(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those in two components."""
        for side in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")), side)
        return pairs.where("_a != _b").drop("_a", "_b")

    best = Window.partitionBy("node").orderBy(F.desc("n"), "hub")
    first = stage(stars.withColumn("k", F.row_number().over(best)).where("k = 1").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    steps: list[Callable[[], DataFrame]] = [
        lambda: first,
        lambda: across(stars.select(F.col("hub").alias("a"), F.col("node").alias("b")).join(first, ["a", "b"], "left_anti")),
        lambda: _cross(shared, labels),
    ]
    for pairs in steps:
        labels = merge_labels(labels, verified(pairs()))
    return labels


def _cross(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of nodes of a key that lie in different components."""
    members = shared.select("key", "node").unionByName(shared.select("key", F.col("hub").alias("node"))).distinct()
    named = members.join(labels, "node")
    mixed = stage(named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key"))
    open_ = stage(named.join(mixed, "key"))
    a, b = (open_.select("key", F.col("node").alias(x), F.col("label").alias(f"_{x}")) for x in "ab")
    return a.join(b, "key").where("_a != _b and a < b").select("a", "b").distinct()


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return components(read_table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s
), x AS (SELECT doc_id, unnest(sh) AS h FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id FROM n LEFT JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
