"""MinHash near-dedup with odd sketches: banded candidates, verified on full sets.

1. One pass over the texts gives each document the size and a 128-bit digest of its
   shingle set, the band keys of its MinHash signature, and an odd sketch: the MinHash
   samples folded into a parity bitmap, in which an even number of equal hits cancels.
2. Documents with the same set form a class, a node of the graph; the row with the smallest
   id stands for it. Only classes go on, so a large group of copies costs one member.
3. Classes that share a band key are compared with the smallest member of that band bucket
   only: as many pairs as members, never all pairs. The odd sketches of a pair, XORed,
   have a population count that grows with the symmetric difference; pairs far above the
   count expected at the threshold are dropped, the rest is verified on full shingle sets.
4. Verified links are contracted to components. Large buckets that still hold several
   components each take a new pivot from outside their first member's component, and their
   members of other components are compared with that one: a round is linear again, and
   members that join a component stay out of the next. Rounds go on while each halves the
   members outside.
5. What still differs is compared by sketches, members outside the first member's component
   against all. Small buckets name the pairs that come close; large ones are dealt as blocks
   with full sets and verified where blocks meet, so that only links leave a task. No pair
   in one bucket stays undecided.

Members meet the data of their bucket in joins salted by member, so a band key that a third
of all documents share is spread over tasks.

A pair at the threshold misses all bands with a probability below ``miss``; bands follow
from it. Sketches only drop pairs over five standard deviations away from the threshold.

Defined cases: a null or blank text has the empty set and no links; fewer than ``width``
words make one shingle of the whole sequence; rows that repeat an id are one document with
all their links, and n_shingles is that of each row's own text; a null id is never linked (component null, kept); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_filter, materialize, words_of
from .components import connected_components

WIDTH = 5
ROWS = 5
MISS = 1e-5
SKETCH_WORDS = 8
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
SMALL_BUCKET = 64
SALTS = 16
_WORD_CACHE: dict[bytes, int] = {}
_WORD_CACHE_MAX = 600_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, through a bounded cache of this worker."""
    cache = _WORD_CACHE
    if len(cache) > _WORD_CACHE_MAX:
        cache.clear()
    get = cache.get
    out = [get(w) for w in words]
    if None in out:
        for i, x in enumerate(out):
            if x is None:
                out[i] = cache[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return np.array(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the ``width``-word shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = len(h) - width + 1
    if n < 1:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = _mix(mixed + h[k : k + n])
    return np.unique(mixed)


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def sketch_limit(threshold: float, samples: int, bits: int, sigmas: float = 5.5) -> int:
    """Largest XOR population count that a pair at the threshold can plausibly show."""
    different = samples * (1 - threshold) + sigmas * math.sqrt(samples * threshold * (1 - threshold))
    fill = bits * (1 - math.exp(-2 * 2 * min(different, samples) / bits)) / 2
    return math.ceil(fill + 2 * math.sqrt(fill))


class Signer:
    """MinHash band keys and odd sketch of a shingle set."""

    def __init__(self, bands: int, rows: int = ROWS, sketch_words: int = SKETCH_WORDS):
        seeds = np.random.Generator(np.random.PCG64(20240229))
        self.bands, self.rows, self.samples, self.bits = bands, rows, bands * rows, 64 * sketch_words
        self.mul = seeds.integers(0, 1 << 63, self.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = seeds.integers(0, 1 << 63, self.samples, dtype=np.uint64)
        self.salt = _mix(np.arange(1, self.samples + 1, dtype=np.uint64))
        self.band_salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(1 << 40))

    def samples_of(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.samples, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 512):
            part = shingles[at : at + 512]
            np.minimum(least, (self.mul[:, None] * part[None, :] + self.add[:, None]).min(axis=1), out=least)
        return least

    def sign(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(band keys, sketch words), both as signed 64-bit integers."""
        least = self.samples_of(shingles)
        keys = self.band_salt.copy()
        for column in least.reshape(self.bands, self.rows).T:
            keys = _mix(keys ^ column)
        places = _mix(least ^ self.salt) % np.uint64(self.bits)
        parity = np.bincount(places.astype(np.int64), minlength=self.bits) & 1
        words = np.packbits(parity.astype(np.uint8)).view(np.uint64)
        return keys.view(np.int64), words.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, width: int = WIDTH) -> DataFrame:
    """id, text_hash, n_shingles, set_hash, bands, sketch: one row per document, without its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(bands)
        for batch in batches:
            rows = []
            for key, seen, text in zip(batch["id"], batch["text_hash"], batch["text"], strict=True):
                s = shingle_set(text, width)
                if len(s):
                    keys, sketch = signer.sign(s)
                    rows.append((key, seen, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest(), keys, sketch))
                else:
                    rows.append((key, seen, 0, None, None, None))
            yield pd.DataFrame(rows, columns=["id", "text_hash", "n_shingles", "set_hash", "bands", "sketch"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, "id string, text_hash long, n_shingles long, set_hash string, bands array<long>, sketch array<long>")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach ``percent``. ``docs``: node, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, sets = [], {}
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True):
                if b not in sets:  # a pivot repeats within its partition
                    if len(sets) > 64:
                        sets.clear()
                    sets[b] = shingle_set(tb, width)
                x, y = shingle_set(ta, width), sets[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both) and both:
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    left = docs.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInPandas(run, f"a {kind}, b {kind}")


def _xor_count(a: str, b: str, words: int):
    total = F.lit(0)
    for k in range(words):
        total = total + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return total


def _near(pairs: DataFrame, nodes: DataFrame, percent: int, limit: int) -> DataFrame:
    """Pairs whose set sizes and sketches allow the threshold."""
    left = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (_xor_count("sa", "sb", SKETCH_WORDS) <= limit)).select("a", "b")


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the nodes in ``wanted`` (node, id, text_hash).

    A bitmap keeps rows that nobody wants out of the join's shuffle; what it lets through by
    a hash collision ends at the join.
    """
    wanted = materialize(wanted.distinct(), "near-wanted")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).filter("id is not null")
    found = rows.filter(id_filter(wanted, "id")(F.col("id"))).join(wanted, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])
    return materialize(found.select("node", "text"), "near-texts")


def _shingles(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingle_set(t, width).view(np.int64) for t in batch["text"]]})

    kind = texts.schema["node"].dataType.simpleString()
    return texts.mapInPandas(run, f"node {kind}, shingles array<long>")


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64).view(np.uint64)


def _cross_pairs(one: pd.DataFrame, all_: pd.DataFrame, bucket: int, percent: int, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``one``, the places in ``all_`` of another component whose size and
    sketch allow a link, where ``bucket`` is the first band that both share."""
    sketches, bands = _stack(all_["sketch"]), _stack(all_["bands"])
    n, c = all_["n_shingles"].to_numpy(), all_["component"].to_numpy()
    own_sketches, own_bands = _stack(one["sketch"]), _stack(one["bands"])
    key = np.array([bucket], np.int64).view(np.uint64)[0]
    for i, (component, size) in enumerate(zip(one["component"], one["n_shingles"], strict=True)):
        near = (c != component) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
        near &= np.bitwise_count(sketches ^ own_sketches[i]).sum(axis=1) <= limit
        at = np.flatnonzero(near)
        first = (bands[at] == own_bands[i]).argmax(axis=1)
        yield i, at[own_bands[i][first] == key]


def _close_pairs(members: DataFrame, percent: int, limit: int, kind: str) -> DataFrame:
    """Pairs (a > b) across components in mixed buckets of at most ``SMALL_BUCKET`` members."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        one = group[group["component"] != group["main"]]
        nodes, out = group["node"].to_numpy(), set()
        if len(one):
            own = one["node"].to_numpy()
            for i, found in _cross_pairs(one, group, int(group["bucket"].iloc[0]), percent, limit):
                out |= {(max(own[i], x), min(own[i], x)) for x in nodes[found]}
        return pd.DataFrame(sorted(out), columns=["a", "b"])

    return members.groupBy("bucket").applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def _block_links(members: DataFrame, shingles: DataFrame, percent: int, limit: int, kind: str) -> DataFrame:
    """Links across components in large mixed buckets, verified where blocks meet.

    Members outside the first member's component are the queries; each block of queries
    meets each block of members, with their full sets. A block is bounded in members and in
    shingles, and only links leave the task.
    """
    outside = F.col("component") != F.col("main")
    blocks = lambda rows, total: F.ceil(F.greatest(rows / BLOCK, total / BLOCK_SHINGLES)).cast("long")
    counts = members.groupBy("bucket").agg(
        blocks(F.count_if(outside), F.sum(F.when(outside, F.col("n_shingles")).otherwise(0))).alias("q_blocks"), blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("x_blocks")
    )
    rows = _meet(members, counts).join(shingles, "node").withColumn("h", F.xxhash64("node"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = rows.filter(outside).select("*", F.pmod("h", "q_blocks").alias("q"), each("x_blocks").alias("x"), F.lit(True).alias("asked"))
    against = rows.select("*", each("q_blocks").alias("q"), F.pmod("h", "x_blocks").alias("x"), F.lit(False).alias("asked"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        one, all_ = group[group["asked"]].reset_index(drop=True), group[~group["asked"]].reset_index(drop=True)
        out = []
        if len(one) and len(all_):
            nodes, components, sets = all_["node"].to_numpy(), all_["component"].to_numpy(), all_["shingles"].to_numpy()
            for i, found in _cross_pairs(one, all_, int(group["bucket"].iloc[0]), percent, limit):
                x, linked = one["shingles"][i], set()
                for j in found:
                    if components[j] not in linked and _reaches(x, sets[j], percent):
                        linked.add(components[j])
                        out.append((one["node"][i], nodes[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    columns = ["bucket", "q", "x", "asked", "node", "component", "n_shingles", "sketch", "bands", "shingles"]
    both = asked.select(columns).unionByName(against.select(columns))
    return both.groupBy("bucket", "q", "x").applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The similarity of two sets, each sorted as unsigned integers, reaches ``percent``."""
    x, y = (np.asarray(v, dtype=np.int64).view(np.uint64) for v in ((x, y) if len(x) <= len(y) else (y, x)))
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def near_components(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, miss: float = MISS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    bands = bands_for(percent / 100, miss=miss)
    limit = sketch_limit(percent / 100, bands * ROWS, 64 * SKETCH_WORDS)
    kind = "bigint"  # of nodes
    signed = materialize(signatures(docs, id_col, text_col, bands, width), "near-signed")
    linked = signed.filter("n_shingles > 0 and id is not null")
    classes = linked.groupBy("set_hash").agg(F.min(F.struct("id", "text_hash")).alias("first"))
    classes = materialize(classes.select("set_hash", F.monotonically_increasing_id().alias("node"), "first.id", "first.text_hash"), "near-classes")
    nodes = linked.join(classes, ["set_hash", "id", "text_hash"]).select("node", "id", "text_hash", "n_shingles", "bands", "sketch")
    nodes = materialize(nodes.dropDuplicates(["node"]), "near-nodes")
    owners, nodes = nodes.select("node", "id", "text_hash"), nodes.drop("id", "text_hash")
    member = materialize(linked.select("id", "set_hash").join(classes.select("set_hash", "node", F.col("id").alias("first_id")), "set_hash").select("id", "node", "first_id"), "near-members")
    # Rows that repeat an id with other texts are one document: their classes belong together.
    torn = member.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b < last")
    same = member.join(torn, "id").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()

    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    pivots = rows.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = materialize(_meet(rows, pivots), "near-buckets")
    texts = _texts(docs, shared.select("node").distinct().join(owners, "node"), id_col, text_col)
    star = shared.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    star = materialize(_near(star, nodes.drop("bands"), percent, limit), "near-star")
    edges = materialize(_verified(star, texts, width, percent).unionByName(same), "near-links")
    labels = connected_components(edges) if not edges.isEmpty() else nodes.select("node", F.col("node").alias("component")).limit(0)

    turn, before = 0, math.inf
    while True:
        mixed = _mixed_members(shared, labels, nodes)
        large = mixed.filter(F.col("members") > SMALL_BUCKET)
        outside = large.filter("component <> main").count()
        if not outside or 2 * outside > before:  # rounds go on while each halves what differs
            break
        turn, before = turn + 1, outside
        links = _pivot_links(large, turn, nodes, texts, percent, limit, width)
        if links.isEmpty():
            break
        labels = connected_components(_as_edges(labels).unionByName(links))

    pairs = materialize(_close_pairs(mixed.filter(F.col("members") <= SMALL_BUCKET), percent, limit, kind).join(star, ["a", "b"], "left_anti"), "near-more")
    found = _verified(pairs, texts, width, percent)
    if not large.isEmpty():
        sets = materialize(_shingles(texts.join(large.select("node").distinct(), "node", "left_semi"), width), "near-sets")
        found = found.unionByName(_block_links(large, sets, percent, limit, kind))
    found = materialize(found, "near-links")
    if not found.isEmpty():
        labels = connected_components(_as_edges(labels).unionByName(found))

    smallest = labels.join(owners, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    named = labels.join(smallest, "component").select("node", "component_id")
    component = member.join(named, "node", "left").groupBy("id").agg(F.min(F.coalesce("component_id", "first_id")).alias("component_id"))
    result = signed.select("id", "n_shingles").join(component, "id", "left")
    component_id = F.coalesce("component_id", "id")
    return result.select(
        F.col("id").alias(id_col), "n_shingles", component_id.alias("component_id"), F.col("id").eqNullSafe(component_id).alias("kept")
    )


def _meet(members: DataFrame, by_bucket: DataFrame) -> DataFrame:
    """``members`` (bucket, node, ...) with the one row of their bucket, salted by node."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    spread = by_bucket.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return members.withColumn("salt", salt).join(spread, ["bucket", "salt"]).drop("salt")


def _as_edges(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _mixed_members(shared: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of buckets of three or more that lie in different components: bucket, members,
    node, component, main (the first member's component), n_shingles, sketch, bands."""
    named = shared.filter("members > 2").join(labels, "node", "left").select("bucket", "members", "node", F.coalesce("component", "node").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "node").alias("main")).filter("low < high").select("bucket", "main")
    members = _meet(named, mixed).join(nodes, "node")
    return materialize(members.select("bucket", "members", "node", "component", "main", "n_shingles", "sketch", "bands"), "near-mixed")


def _pivot_links(large: DataFrame, turn: int, nodes: DataFrame, texts: DataFrame, percent: int, limit: int, width: int) -> DataFrame:
    """Links of the members of large mixed buckets with a new pivot, drawn by a hash of node
    and ``turn`` from outside the first member's component."""
    draw = F.xxhash64("node", F.lit(turn))
    pivots = large.filter("component <> main").groupBy("bucket").agg(F.min_by("node", draw).alias("pivot"), F.min_by("component", draw).alias("own"))
    star = _meet(large.select("bucket", "node", "component"), pivots).filter("component <> own").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    near = materialize(_near(star, nodes.drop("bands"), percent, limit), "near-star")
    return materialize(_verified(near, texts, width, percent), "near-links")


def keep_first_of_group(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group, with their own columns."""
    drop = near_components(docs, percent, id_col, text_col).filter("not kept").select(F.col(id_col).alias("_drop"))
    return docs.join(drop, docs[id_col] == drop["_drop"], "left_anti")
