"""N-gram Jaccard join: a MinHash LSH forest (sorted prefix tries, prefixes shortened per text) and exact verification."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.llm.common import discard, materialize, release
from marquetry.llm.components import _roots, components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
#: Bits of each level of a trie, most significant first. The first levels keep strangers apart; the deeper ones refine.
LEVELS = (14, 14, 14, 5, 5, 5, 5)
MAX_DEPTH = len(LEVELS)
#: How far below the depth that all trees would need alike a prefix may be shortened, for trees that must stay deep.
SPARE_LEVELS = 2
TARGET_RECALL = 0.9999
#: Texts under one trie node from which on its prefix is kept longer, if the other trees reach the target without it.
HOT = 64
#: Rows of the sorted forest that one task walks, texts that are compared at once, and bytes that may be broadcast.
RUN_ROWS = 400_000
BLOCK = 512
MAX_BROADCAST_BYTES = 16 << 20

_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of a text's runs of `size` words between ASCII white space, in order; a shorter text is one run."""
    found = (text or "").encode("utf-8", "replace").split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = out + h[k : k + n] * _WEIGHTS[k % len(_WEIGHTS)] * np.uint64(2 * (k // len(_WEIGHTS)) + 1)
    return _mix(out)


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def least_depth(threshold: float, trees: int, target: float) -> int:
    """The shortest prefix looked at: SPARE_LEVELS below the depth at which all trees together reach the target."""
    deep = MAX_DEPTH
    while deep > 1 and (1 - threshold**deep) ** trees > 1 - target:
        deep -= 1
    return max(1, deep - SPARE_LEVELS)


def _shift(depth: int) -> int:
    return sum(LEVELS[depth:])


def trie_keys(hashes: np.ndarray, trees: int) -> np.ndarray:
    """One key per tree: MAX_DEPTH min-hashes, so many bits of each as LEVELS says, so that sorted keys are the trie."""
    a, b = _functions(trees * MAX_DEPTH)
    low = (hashes >> np.uint64(20)).astype(np.uint32)
    least = np.full(trees * MAX_DEPTH, np.iinfo(np.uint32).max, dtype=np.uint32)
    for k in range(0, len(low), 1024):
        np.minimum(least, (low[k : k + 1024, None] * a + b).min(axis=0), out=least)
    levels = least.astype(np.int64).reshape(trees, MAX_DEPTH)
    key = np.zeros(trees, dtype=np.int64)
    for k, bits in enumerate(LEVELS):
        key = (key << bits) | (levels[:, k] & ((1 << bits) - 1))
    return key


def walked(tree: np.ndarray, key: np.ndarray, least: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows in company, cool depth) of a run of the sorted forest.

    A row is in company if a neighbour in sorted order shares a prefix of `least` levels with it; the groups at both
    ends of a run count as such, as they may go on in the next one. The cool depth is the shortest prefix that at
    most `hot` rows of the run share, MAX_DEPTH + 1 where even whole keys are shared by more.
    """
    cool = np.full(len(key), MAX_DEPTH + 1, dtype=np.int32)
    for depth in range(MAX_DEPTH, least - 1, -1):
        prefix = key >> _shift(depth)
        starts = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (tree[1:] != tree[:-1])])
        counts = np.diff(np.r_[starts, len(key)])
        size = np.repeat(counts, counts)
        cool[size <= hot] = depth
    company = size > 1
    company[: counts[0]] = company[len(key) - counts[-1] :] = True
    return np.flatnonzero(company), cool


def chosen_depths(cool: np.ndarray, threshold: float, target: float, least: int) -> np.ndarray:
    """The prefix length at which each text (row) is matched in each tree (column).

    All prefixes start at MAX_DEPTH and are shortened one level at a time, tree by tree, until a pair at the threshold
    meets with the target recall, 1 - prod(1 - threshold^depth). Prefixes shorter than a tree's cool depth are taken only
    if no others are left. The choice rests on the sizes of crowded nodes alone, never on whether a single pair met.
    """
    gain = np.log1p(-(threshold ** np.arange(1, MAX_DEPTH + 1, dtype=np.float64)).clip(max=1 - 1e-12))
    gain = np.r_[0.0, gain]  # log of the chance to miss, by depth
    goal = np.log(max(1 - target, 1e-300))
    depth = np.full(cool.shape, MAX_DEPTH, dtype=np.int32)
    miss = np.full(len(cool), cool.shape[1] * gain[MAX_DEPTH])
    for crowded in (False, True):
        for level in range(MAX_DEPTH - 1, least - 1, -1):
            for t in range(cool.shape[1]):
                move = (miss > goal) & (depth[:, t] == level + 1) & (crowded | (cool[:, t] <= level))
                depth[move, t] = level
                miss[move] += gain[level] - gain[level + 1]
    return depth


def similar_pairs(sets: list[np.ndarray], threshold: float, split: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of sorted distinct hash sets with Jaccard similarity >= threshold; if split, only i < split <= j.

    Shingles of few sets are counted pair by pair, those of many by products of 0/1 matrices, 2048 shingles at a time.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(m), sizes)
    flat = np.concatenate(sets) if m else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
    counts = np.diff(np.r_[starts, len(flat)])
    shared = np.zeros(m * m, dtype=np.float32)
    for f in range(2, 9):
        at = starts[counts == f]
        if len(at):
            rows = owner[at[:, None] + np.arange(f)]
            for i in range(f):
                for j in range(i + 1, f):
                    shared += np.bincount(rows[:, i] * m + rows[:, j], minlength=m * m).astype(np.float32)
    shared = shared.reshape(m, m)
    many = np.flatnonzero(counts > 8)
    for k in range(0, len(many), 2048):
        part = many[k : k + 2048]
        block = np.zeros((m, len(part)), dtype=np.float32)
        lengths = counts[part]
        column = np.repeat(np.arange(len(part)), lengths)
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        block[owner[np.repeat(starts[part], lengths) + inside], column] = 1
        shared += np.triu(block @ block.T, 1)
    i, j = np.nonzero(shared)
    both = shared[i, j].astype(np.float64)
    ok = both * (1 + threshold) >= threshold * (sizes[i] + sizes[j]) - 1e-9
    if split:
        ok &= (i < split) & (j >= split)
    return i[ok], j[ok]


def forest(nodes: DataFrame, threshold: float, trees: int, target_recall: float) -> DataFrame:
    """(node, tree, key, depth) of texts that share a short prefix with another, from (node, keys).

    The keys of all trees are sorted by range, node numbers last, so that runs stay even however many texts share a
    key: each run is a piece of the tries. One walk over a run tells how crowded each node is; then each text's prefixes are
    shortened until the target (`chosen_depths`). At most one row per tree meets at a text.
    """
    least = least_depth(threshold, trees, target_recall)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]  # about RUN_ROWS rows of three numbers
        if parts:
            run = pd.concat(parts, ignore_index=True)
            at, cool = walked(run["tree"].to_numpy(), run["key"].to_numpy(), least, HOT)
            yield run.iloc[at].assign(cool=cool[at])
            del parts, run, at, cool
            release()

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                part, held = held, None
            else:
                batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
                cut = int(np.searchsorted(batch["node"], batch["node"].iloc[-1])) if len(batch) else 0
                part, held = batch.iloc[:cut], batch.iloc[cut:]  # the last text may go on
            if part is not None and len(part):
                number, tree = np.unique(part["node"], return_inverse=True)[1], part["tree"].to_numpy()
                cool = np.zeros((number.max() + 1, trees), dtype=np.int32)
                cool[number, tree] = part["cool"]
                yield part.drop(columns="cool").assign(depth=chosen_depths(cool, threshold, target_recall, least)[number, tree])
                del part, number, tree, cool
                release()

    rows = nodes.select("node", F.posexplode("keys").alias("tree", "key"))
    runs = max(1, nodes.count() * trees // RUN_ROWS)
    # Sorted runs are written, so that a lost one is made again from the same splitters.
    company = rows.repartitionByRange(runs, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    company = materialize(company.mapInPandas(walk, "node long, tree int, key long, cool int"), "company")
    out = materialize(company.repartition("node").sortWithinPartitions("node", "tree").mapInPandas(choose, "node long, tree int, key long, depth int"), "depths")
    discard(company)
    return out


def _block_pairs(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """(i, j), i <= j: blocks of (node, block) that share a bucket of (node, bucket), and each with itself."""
    held = members.join(blocks.select("node", "block"), "node").select("bucket", "block").distinct()
    pairs = held.select("bucket", F.col("block").alias("i")).join(held.select("bucket", F.col("block").alias("j")), "bucket").where("i < j").select("i", "j").distinct()
    return pairs.union(blocks.select(F.col("block").alias("i"), F.col("block").alias("j")).distinct())


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, target_recall: float = TARGET_RECALL, key_col: str = "doc_id", text_col: str = "text", heads: bool = False) -> DataFrame:
    """Documents whose sets of `size`-word shingles have a Jaccard similarity of at least `threshold`.

    One row (key_col, class_id, n_links) per row of docs. n_links counts the other rows whose text is similar, copies
    included; class_id is the least key of the component that the links form. A text of fewer than `size` words has one
    shingle, all its words. Texts without words, null ones too, have no shingles and no links: class_id is the row's own
    key. Null keys are never a class_id unless the whole class has none. Rows of equal key count separately. An empty
    table gives an empty result; other columns of docs, whatever their names, are not looked at. heads adds digest (SHA-256
    of the text) and is_head: whether the row's text is its class's first by least key, then digest.

    Equal texts are one node from the start. A node's signature gives one key per tree of the forest; `forest` chooses
    the prefix length at which it is matched in each tree. Two nodes are candidates if they share the shorter of their
    prefixes in some tree. Nodes of one prefix are linked to the least of them (a star, never all pairs). Components of the
    stars up to BLOCK nodes are compared whole; larger ones are cut into blocks of nodes with a common least neighbour, and
    only blocks that share a prefix are compared, so that a long chain costs its length. Comparison is exact. A
    task returns counts and a star for each block pair, not pairs. Nothing is capped. The result is written to the
    shared folder and what led to it deleted there.
    """
    spark = docs.sparkSession
    least_level = least_depth(threshold, trees, target_recall)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, counts = [], []
            for text in batch.pop("text"):
                h = shingle_hashes(text, size)
                counts.append(len(h))
                keys.append(trie_keys(h, trees) if len(h) else None)
            yield batch.assign(n=counts, keys=keys)
            del batch, keys, counts
            release()

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(key_col).cast("long").alias("doc"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    # Nulls would turn a batch's keys into floating point numbers.
    whole = rows.select(F.coalesce("doc", F.lit(0)).alias("doc"), F.col("doc").isNotNull().alias("keyed"), "digest", "text")
    signed = whole.mapInPandas(sign, "doc long, keyed boolean, digest binary, n int, keys array<bigint>")
    signed = materialize(signed.withColumn("doc", F.when(F.col("keyed"), F.col("doc"))), "signed")
    nodes = signed.where("n > 0").groupBy("digest").agg(F.min("doc").alias("least"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    depths = forest(nodes.select("node", "keys"), threshold, trees, target_recall)
    # A node belongs to its own prefix and to shorter ones, at which others may be matched with it.
    shifts = F.array(*[F.lit(_shift(d)) for d in range(1, MAX_DEPTH + 1)])
    held = depths.withColumn("d", F.explode(F.sequence(F.lit(least_level), F.col("depth"))))
    held = held.select("node", F.expr("d = depth").alias("asks"), F.xxhash64("tree", "d", F.call_function("shiftright", "key", F.element_at(shifts, F.col("d")))).alias("bucket"))
    hubs = held.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n"), F.max("asks").alias("asked")).where("n > 1 and asked").select("bucket", "hub")
    hubs = materialize(hubs, "hubs")  # so that a bucket with many nodes can be split in the join
    stars = materialize(held.join(hubs, "bucket").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"), "bucket"), "stars")
    roots = materialize(components(stars.select("u", "v")), "candidates")
    n_candidates = roots.count()

    sizes = materialize(roots.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    groups = max(1, n_candidates // BLOCK)
    dealt = roots.join(sizes, "root").join(nodes.select("node", "digest", "least", "copies"), "node")
    dealt = materialize(dealt, "dealt")
    small = dealt.where(F.col("size") <= BLOCK).select("digest", "least", "node", "copies", F.pmod(F.xxhash64("root"), F.lit(groups)).alias("i"))
    small = small.withColumns({"block": F.lit(0).cast("long"), "j": F.col("i"), "large": F.lit(False)})
    used = [signed, nodes, depths, hubs, stars, roots, sizes, dealt]
    large = dealt.where(F.col("size") > BLOCK)
    if large.head(1):
        # Neighbours share a block: those of one least neighbour, many such groups to a block or a large one over several.
        label = materialize(stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("hub")), "labels")
        blocks = large.join(label, "node", "left").withColumn("hub", F.least("node", "hub"))
        blocks = materialize(blocks, "neighbours")
        crowd = materialize(blocks.groupBy("root", "hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "crowds")
        pooled = F.xxhash64("root", F.pmod(F.xxhash64("hub"), F.ceil(F.col("size") * 2 / BLOCK)))
        alone = F.xxhash64("root", "hub", F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(1))
        blocks = materialize(blocks.join(crowd, ["root", "hub"]).withColumn("block", F.when(F.col("parts") > 1, alone).otherwise(pooled)), "blocks")
        members = stars.select(F.col("u").alias("node"), "bucket").union(stars.select("v", "bucket").distinct())
        pairs = materialize(_block_pairs(members, blocks), "pairs")
        sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
        each = blocks.join(sides, "block").select("digest", "least", "node", "copies", "i", "block", "j", F.lit(True).alias("large"))
        wanted = materialize(small.unionByName(each), "wanted")
        used += [label, blocks, crowd, pairs, wanted]
    else:
        wanted = small
    texts = rows.join(F.broadcast(wanted) if wanted.count() * 128 <= MAX_BROADCAST_BYTES else wanted, (rows["digest"] == wanted["digest"]) & rows["doc"].eqNullSafe(wanted["least"]))

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(hashes=[np.unique(shingle_hashes(t, size)).tobytes() for t in batch.pop("text")])
            del batch
            release()

    sets = texts.select("node", "copies", "i", "j", "block", "large", "text").mapInPandas(shingle, "node long, copies long, i long, j long, block long, large boolean, hashes binary")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")  # rows of equal key and text bring a node twice
        first, second, large = pdf["i"].iloc[0], pdf["j"].iloc[0], bool(pdf["large"].iloc[0])
        pdf = pdf.assign(later=pdf["block"] != first).sort_values(["later", "node"], ignore_index=True)
        split = int((~pdf["later"]).sum()) if large and first != second else 0
        i, j = similar_pairs([np.frombuffer(h, dtype=np.uint64) for h in pdf["hashes"]], threshold, split)
        release()
        copies = pdf["copies"].to_numpy(dtype=np.float64)
        n = len(pdf)
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"node": node, "root": node[_roots(n, i, j)], "links": links.astype(np.int64), "large": pdf["large"]})

    checked = materialize(sets.groupBy("large", "i", "j").applyInPandas(verify, "node long, root long, links long, large boolean"), "checked")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("large").alias("large"))
    merged = checked.where("large")
    if merged.head(1):
        joined = materialize(components(merged.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("root", "whole"), "joined")
        links = links.join(joined, "node", "left").withColumn("root", F.when(F.col("large"), F.coalesce("whole", "node")).otherwise(F.col("root"))).drop("whole")
        used.append(joined)
    placed = nodes.select("node", "digest", "least", "copies").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialize(placed, "placed")
    ids = materialize(placed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("keyless"), "least", "digest")).alias("first")), "ids")
    head = F.col("first.digest").alias("head")
    classes = placed.join(ids, "root").select("digest", F.col("first.least").alias("class_id"), head, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc", "digest").join(classes, "digest", "left")
    is_head = (F.coalesce("head", "digest") == F.col("digest")) & F.coalesce("class_id", "doc").eqNullSafe(F.col("doc"))
    more = [F.lower(F.hex("digest")).alias("digest"), is_head.alias("is_head")] if heads else []
    out = out.select(F.col("doc").alias(key_col), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *more)
    out = materialize(out, "links")
    for frame in [*used, checked, placed, ids]:
        discard(frame)
    return out
