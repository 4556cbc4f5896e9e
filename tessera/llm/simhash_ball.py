"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within ``radius`` bits of one another always share a
point that is within ``radius / 2`` of both. So every distinct fingerprint
stands for all of its variants within half the radius, and fingerprints meet
where they share a variant.

Shuffling the variants themselves would move 2,081 rows per fingerprint. The
shuffle here is on the leading bits of the variant: a fingerprint is sent once
to every prefix that one of its variants can have (1 + b + b(b-1)/2 of 2^b), and
the receiving task writes out just those variants that carry its prefix. All
variants are compared and a few dozen rows per fingerprint travel. b grows with the
number of fingerprints. Near copies share their leading bits, so the variants of
each prefix are counted and a prefix with too many grows by itself; the receiver
writes them out in blocks, so that its memory is bounded.

Members of one variant's group are pairwise within the radius (each is within
half of it from the variant), so a star over the group keeps every component
without writing out its pairs; the star's pairs are verified all the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.minhash import _A, _B
from tessera.llm.common import bounded_batches, checkpointed, join_spread
from tessera.llm.components import connected_components

BITS = 64
#: Variants of a group of fingerprints with one prefix, on average, and the most that a group may have before it is split.
VARIANTS_PER_GROUP, GROUP_VARIANTS = 2_000_000, 16_000_000
#: Variants that a receiving task writes out at a time; 60 bytes each.
BLOCK_VARIANTS = 1_000_000
#: Bits by which the prefix of a group with too many variants grows; what a row of such a group counts beside its variants.
STEP, ROW_COST = 6, 16
BROADCAST_PREFIXES = 1_000_000
#: Bands of MinHash values that near-duplicate candidates come from: a pair of similarity s shares none with (1 - s**5)**25.
BANDS, BAND_ROWS = 25, 5


# ----------------------------------------------------------------- fingerprints
def _majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of ``hashes``; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str | None, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; fewer words: of the whole sequence.

    Bytes: lower() changes A-Z only and split() knows just the six ASCII blanks.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, seed)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-k])).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)


def shingle_fingerprint(text: str | None, k: int = 4) -> int:
    """The fingerprint of all k-word shingles, each counted as often as it occurs."""
    return _majority(shingle_hashes(text, k))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The distinct hashes of the text's k-word shingles, in order."""
    return np.unique(shingle_hashes(text, k))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band: the hash of its BAND_ROWS MinHash values and its number. None for no shingle."""
    if not len(shingles):
        return np.empty(0, dtype=np.int64)
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[at : at + 1024, None] * _A[None, : len(least)] + _B[None, : len(least)]).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], dtype=np.uint64).view(np.int64)


def similar(x: bytes, y: bytes, threshold: float) -> bool:
    """Whether the Jaccard similarity of two shingle sets is at least ``threshold``."""
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (len(a) + len(b) - both)


def with_fingerprint(docs: DataFrame, text_col: str = "text", k: int = 4, out: str = "fp") -> DataFrame:
    """Add the shingle fingerprint (BIGINT, the 64 bits as they are). Null or empty text: 0."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([shingle_fingerprint(t, k) for t in s], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, of(text_col))


def _digest(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 42)).view(np.int64))


def _prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        sets = [shingle_set(t) for t in s]
        fps = np.array([_majority(x) for x in sets], dtype=np.uint64).view(np.int64)
        yield pd.DataFrame({"node": [_digest(x) for x in sets], "fp": fps, "keys": [band_keys(x) for x in sets]})


def _sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        sets = [shingle_set(t) for t in s]
        yield pd.DataFrame({"node": [_digest(x) for x in sets], "shingles": [x.tobytes() for x in sets]})


# ------------------------------------------------------------------ ball hashing
def _masks(width: int, flips: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``flips`` (0 to 2) bits set."""
    one = np.uint64(1) << np.arange(width, dtype=np.uint64)
    found = [np.zeros(1, dtype=np.uint64)]
    if flips >= 1:
        found.append(one)
    if flips >= 2:
        i, j = np.triu_indices(width, 1)
        found.append(one[i] | one[j])
    return np.concatenate(found)


def _forest(pairs: np.ndarray) -> np.ndarray:
    """At most one edge per node: (node, root) of the graph that ``pairs`` spans."""
    nodes, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(pairs.shape).T
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))  # roots only: every other node is below its root
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    apart = parent != np.arange(len(nodes))
    return np.stack([nodes[apart], nodes[parent[apart]]], axis=1)


def _variants(width: int, flips: int) -> int:
    """How many numbers of ``width`` bits have at most ``flips`` bits set."""
    return sum(math.comb(width, i) for i in range(flips + 1)) if flips >= 0 else 0


def _meet(fps: np.ndarray, top: np.ndarray, bits: int, half: int, radius: int) -> np.ndarray:
    """Edges among distinct ``fps``, which are ``top`` bits off the leading ``bits`` of the variants that are compared."""
    low = BITS - bits
    rest = fps & np.uint64((1 << low) - 1)
    variants, owners = [], []
    for flips in range(half + 1):
        at = np.nonzero(top == flips)[0]
        masks = _masks(low, half - flips)
        variants.append((rest[at][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(at.astype(np.uint32), len(masks)))
    v, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v)
    v, owner = v[order], owner[order]
    same = np.concatenate(([False], v[1:] == v[:-1]))
    if not same.any():
        return np.empty((0, 2), dtype=np.uint64)
    hub = owner[np.maximum.accumulate(np.where(same, 0, np.arange(len(v))))]
    a, b = hub[same].astype(np.uint64), owner[same].astype(np.uint64)
    pairs = np.unique(np.minimum(a, b) << np.uint64(32) | np.maximum(a, b))
    x, y = fps[(pairs >> np.uint64(32)).astype(np.int64)], fps[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    near = np.bitwise_count(x ^ y) <= radius
    return _forest(np.stack([x[near], y[near]], axis=1))


def meet(fps: np.ndarray, prefix: int, bits: int, half: int, radius: int, block: int = BLOCK_VARIANTS) -> np.ndarray:
    """Spanning edges among distinct ``fps`` that share a variant whose leading ``bits`` are ``prefix``.

    Where these are more than ``block`` variants, those of each longer prefix are
    written out by themselves, so that memory stays bounded however alike ``fps`` are.
    """
    found, size, todo = [], 0, [(prefix, bits, fps)]
    while todo:
        prefix, bits, among = todo.pop()
        low = BITS - bits
        top = np.bitwise_count((among >> np.uint64(low)) ^ np.uint64(prefix)) if bits else np.zeros(len(among), dtype=np.uint8)
        among, top = among[top <= half], top[top <= half]
        if len(among) < 2:
            continue
        load = sum(int(n) * _variants(low, half - flips) for flips, n in enumerate(np.bincount(top)))
        if load > block and low:
            step = min(4, low)
            todo += [(prefix << step | q, bits + step, among) for q in range(1 << step)]
            continue
        found.append(_meet(among, top, bits, half, radius))
        size += len(found[-1])
        if size > block:
            found = [_forest(np.concatenate(found))]
            size = len(found[0]) // 2
    return _forest(np.concatenate(found)) if found else np.empty((0, 2), dtype=np.uint64)


def prefix_bits(n: int, half: int, width: int = BITS) -> int:
    """Leading bits that split the variants of ``n`` fingerprints into groups of VARIANTS_PER_GROUP, if they are spread evenly."""
    return min(24, max(0, math.ceil(math.log2(max(1, n * _variants(width, half) / VARIANTS_PER_GROUP)))))


def _routed(fps: DataFrame, bits: int, half: int, most: int) -> DataFrame:
    """``fps(view, fp)`` to ``(view, bits, prefix, fp)``: once for each prefix that a variant can have, long enough for ``most``.

    Fingerprints that are alike share their leading bits. So the variants of each
    prefix are counted, and what has too many is sent on to prefixes of STEP more bits.
    """
    parts, step, at = [], bits, 0
    work = fps.select("view", "fp", F.lit(0).cast("long").alias("prefix"))
    while True:
        at += step
        masks = F.array(*[F.lit(int(m)).cast("long") for m in _masks(step, min(half, step))] if step else [F.lit(0).cast("long")])
        flipped = F.bit_count(F.shiftrightunsigned("fp", BITS - at + step).bitwiseXOR(F.col("prefix"))) if at > step else F.lit(0)
        work = work.withColumn("_m", F.explode(masks)).filter(flipped + F.bit_count("_m") <= half)
        if step:
            tail = F.shiftrightunsigned("fp", BITS - at).bitwiseAND(F.lit((1 << step) - 1).cast("long")).bitwiseXOR(F.col("_m"))
            work = work.withColumn("prefix", F.shiftleft("prefix", step).bitwiseOR(tail))
        work = work.select("view", "fp", "prefix")
        off = F.bit_count(F.shiftrightunsigned("fp", BITS - at).bitwiseXOR(F.col("prefix"))) if at else F.lit(0)
        each = F.element_at(F.array(*[F.lit(_variants(BITS - at, half - f) + ROW_COST) for f in range(half + 1)]), off.cast("int") + 1)
        heavy = work.groupBy("view", "prefix").agg(F.sum(each).alias("load")).filter(F.col("load") > most).select("view", "prefix")
        heavy = checkpointed(heavy)  # no more rows than all variants by `most`
        n = heavy.count()
        if not n or at + STEP > BITS:
            break
        heavy = F.broadcast(heavy) if n <= BROADCAST_PREFIXES else heavy.hint("shuffle_merge")
        parts.append(work.join(heavy, ["view", "prefix"], "left_anti").select("view", F.lit(at).alias("bits"), "prefix", "fp"))
        work, step = work.join(heavy, ["view", "prefix"], "left_semi"), STEP
    return reduce(DataFrame.union, parts, work.select("view", F.lit(at).alias("bits"), "prefix", "fp"))


def fingerprint_links(fps: DataFrame, radius: int = 4, group: int = GROUP_VARIANTS, block: int = BLOCK_VARIANTS) -> DataFrame:
    """Distinct ``fps(view, fp)`` to spanning links ``(view, u, v)`` of fingerprints within ``radius``.

    Only fingerprints of one view are compared. The links join exactly the
    fingerprints that the full set of pairs within the radius would join. A task
    gets no more than ``group`` variants at once and writes out ``block`` of them.
    """
    half = radius // 2
    if radius % 2 or half > 2:
        raise ValueError("the radius must be 0, 2 or 4")
    n = fps.groupBy("view").count().agg(F.max("count")).first()[0] or 0

    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        edges = meet(pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64), int(key[2]), int(key[1]), half, radius, block).view(np.int64)
        return pd.DataFrame({"view": int(key[0]), "u": edges[:, 0], "v": edges[:, 1]})

    sent = _routed(fps, prefix_bits(n, half), half, group)
    return sent.groupBy("view", "bits", "prefix").applyInPandas(of, "view int, u long, v long")


def with_components(docs: DataFrame, id_col: str = "doc_id", fp_col: str = "fp", radius: int = 4) -> DataFrame:
    """Add component_id: the smallest id reachable over fingerprints within ``radius`` bits.

    Equal fingerprints are one node, whatever the number of rows. Null ids never
    become a component_id unless all of a component's ids are null; a row with a
    null fingerprint is linked to none. An empty input gives an empty result; other
    columns pass through, but one that is already called component_id is replaced.
    """
    docs = docs.drop("component_id")
    nodes = checkpointed(docs.filter(F.col(fp_col).isNotNull()).groupBy(F.col(fp_col).alias("_fp")).agg(F.min(id_col).alias("_least")))
    links = fingerprint_links(nodes.select(F.lit(0).alias("view"), F.col("_fp").alias("fp")), radius)
    roots = connected_components(links)
    named = nodes.join(roots, nodes["_fp"] == roots["node"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_least").alias("_component"))
    named = named.join(least, "_root").select("_fp", "_component")
    out = docs.join(named, docs[fp_col] == named["_fp"], "left")
    own = F.when(F.col(fp_col).isNull(), F.col(id_col)).otherwise(F.col("_component"))
    return out.withColumn("component_id", own).drop("_fp", "_component")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs(u, v)`` whose shingle sets are similar enough."""

    @F.pandas_udf("boolean")
    def alike(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y, threshold) for x, y in zip(xs, ys, strict=True)], dtype=bool)

    a, b = (sets.select(F.col("node").alias(n), F.col("shingles").alias(x)) for n, x in (("u", "x"), ("v", "y")))
    both = join_spread(pairs.join(a, "u"), b, "v", counted=pairs, by="u")
    return checkpointed(both.filter(alike("x", "y")).select("u", "v"))


def _ball_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes(node, fp)`` to pairs (u, v) that join all nodes whose fingerprints the balls join."""
    hubs = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("hub")))
    links = fingerprint_links(hubs.select(F.lit(0).alias("view"), "fp"), radius)
    u, v = (hubs.select(F.col("fp").alias(f), F.col("hub").alias(h)) for f, h in (("u", "a"), ("v", "b")))
    apart = links.select("u", "v").join(u, "u").join(v, "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    alike = join_spread(nodes, hubs, "fp").filter("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    return apart.union(alike)


def _with_main(posted: DataFrame) -> DataFrame:
    """Add to ``posted(token, comp, ...)``, a table, the component that most of a token's rows are of; tokens of one component go."""
    counts = posted.groupBy("token", "comp").agg(F.count("*").alias("k"))
    main = counts.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("most"), F.count("*").alias("comps")).filter("comps > 1")
    return join_spread(posted, main.select("token", F.col("most.comp").alias("main")), "token").filter("main is not null")


def _similar_by_prefix(nodes: DataFrame, sets: DataFrame, threshold: float, width: float = 1.1) -> DataFrame:
    """``nodes(node, comp)`` to pairs (u, v) of different components; all with the similarity ``threshold`` are among them.

    Shingles are in one order, the rarest first. Sets of n and m with that similarity
    share at least k = t / (1 + t) * (n + m) shingles, so the first n - k + 1 of the one
    and m - k + 1 of the other have one in common, and behind it k - 1 are left in both.
    m is known up to its class of sizes (powers of ``width``). Near copies that differ
    too much have shingles of their own in all these places and make no pair, however
    large their group is.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for node, shingles in zip(pdf["node"], pdf["shingles"], strict=True):
                tokens = np.frombuffer(shingles, dtype=np.int64)
                yield pd.DataFrame({"node": node, "n": len(tokens), "token": tokens})

    def share(n: F.Column, m: F.Column) -> F.Column:
        return F.ceil(F.lit(threshold / (1 + threshold)) * (n + m) - 1e-9)

    def size_class(n: F.Column) -> F.Column:
        return F.floor(F.log(n) / math.log(width) + 1e-9)

    some = sets.join(nodes.select("node"), "node", "left_semi")
    tokens = checkpointed(some.select("node", "shingles").mapInPandas(listed, "node long, n long, token long"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token"))).alias("tokens")
    lists = join_spread(tokens, df, "token").groupBy("node", "n").agg(order).join(nodes, "node")
    n, partner = F.col("n"), F.col("partner")
    classes = F.sequence(size_class(F.ceil(n * threshold)), size_class(F.floor(n / threshold)))
    lists = lists.select("node", "comp", "n", size_class(n).alias("own"), "tokens", F.explode(classes).alias("partner"))
    least = F.greatest(F.ceil(F.pow(F.lit(width), partner) - 1e-6), F.ceil(n * threshold - 1e-9))
    first = F.slice("tokens", F.lit(1), F.greatest(n - share(n, least) + 1, F.lit(0)).cast("int"))
    posted = lists.select("node", "comp", "n", "own", "partner", F.posexplode(first).alias("i", "t")).filter("t.df > 1")
    posted = checkpointed(posted.select(F.col("t.token").alias("token"), "own", "partner", "node", "comp", "n", "i"))
    posted = _with_main(posted)
    a = posted.filter("comp != main").select("token", "own", "partner", *[F.col(c).alias(f"{c}_a") for c in ("node", "comp", "n", "i")])
    b = posted.select("token", F.col("partner").alias("own"), F.col("own").alias("partner"), "main", *[F.col(c).alias(f"{c}_b") for c in ("node", "comp", "n", "i")])
    left = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    apart = F.expr("comp_a != comp_b and (comp_b = main or node_a < node_b)")
    found = a.join(b, ["token", "own", "partner"]).filter(apart & (left >= share(F.col("n_a"), F.col("n_b"))))
    return found.select(F.greatest("node_a", "node_b").alias("u"), F.least("node_a", "node_b").alias("v")).distinct()


def similar_groups(docs: DataFrame, keep: list[str], text_col: str = "text", threshold: float = 0.8, radius: int = 4, broadcast_keys: int = 1_000_000) -> DataFrame:
    """Every row of ``docs`` as its columns ``keep`` and ``component``, the number of its group of near copies.

    Near copies have a Jaccard similarity of at least ``threshold`` of their sets of
    five-word shingles, exactly: each link is verified. Texts with equal sets are one
    node; null texts and texts without words are equal. Nodes meet where their SimHash
    fingerprints (of the set) are within ``radius`` bits, by balls. Pairs that are just
    similar enough are some ten bits apart, beyond any ball that can be written out; so
    nodes also meet where they share one of BANDS keys of BAND_ROWS MinHash values,
    which two texts with a similarity of 0.8 miss once in 20,000. First each is compared
    with one node that it meets. Of the nodes of a bucket that are not in one component
    yet, those pairs are compared that can be similar enough by the rare shingles that
    they share (see _similar_by_prefix). Components are those of all verified pairs that
    meet. No rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(*keep, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("_key"), F.col(text_col).alias("_text"))
    # not deterministic, so that no filter repeats them
    prints_of = F.pandas_udf(_prints, "node long, fp long, keys array<long>").asNondeterministic()
    sets_of = F.pandas_udf(_sets, "node long, shingles binary").asNondeterministic()
    prints = checkpointed(rows.select(*keep, "_key", prints_of("_text").alias("_p")).select(*keep, "_key", "_p.*"))
    nodes = checkpointed(prints.groupBy("node").agg(F.min("_key").alias("_least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = checkpointed(buckets.join(shared, "key").select("key", "node", "n"))
    # the node that meets most others is nearest to what its bucket's nodes are copies of
    known = shared.groupBy("node").agg(F.sum("n").alias("meets"))
    hubs = shared.join(known, "node").groupBy("key").agg(F.max(F.struct("meets", "node")).alias("most")).select("key", F.col("most.node").alias("hub"))
    members = checkpointed(shared.join(hubs, "key").select("key", "node", "hub"))
    star = members.filter("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    star = checkpointed(star.union(_ball_pairs(nodes.select("node", "fp"), radius)).distinct())
    # the sets of nodes that meet another one, from one text each
    met = members.select("node").union(star.select("u")).union(star.select("v")).distinct()
    met = checkpointed(met.join(nodes.select("node", "_least"), "node").select(F.col("node").alias("_node"), "_least"))
    met = F.broadcast(met) if met.count() <= broadcast_keys else met.hint("shuffle_merge")
    sets = rows.join(met, F.col("_key") == F.col("_least")).select("_node", sets_of("_text").alias("s")).filter("_node = s.node")
    sets = checkpointed(sets.select("s.*").dropDuplicates(["node"]))
    links = _verified(star, sets, threshold)
    roots = connected_components(links).withColumnRenamed("node", "_node")
    placed = members.join(roots, members["node"] == roots["_node"], "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("key")
    open_ = checkpointed(placed.join(mixed, "key").select("node", "comp").distinct())
    done = star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rest = checkpointed(_similar_by_prefix(open_, sets, threshold).join(done, ["u", "v"], "left_anti"))
    roots = connected_components(links.union(_verified(rest, sets, threshold))).withColumnRenamed("root", "_root")
    return join_spread(prints.select(*keep, "node"), roots, "node").select(*keep, F.coalesce("_root", "node").alias("component"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: its id and component_id, the smallest id of its group of near copies (see similar_groups).

    Rows of one id are judged by their own texts. A null id gets its group's smallest
    id, which is null only if all of the group's are.
    """
    rows = checkpointed(similar_groups(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_said")), ["_id"], "_said", threshold))
    least = rows.groupBy("component").agg(F.min("_id").alias("component_id"))
    return join_spread(rows, least, "component").select(F.col("_id").alias(id_col), "component_id")
