"""Near duplicates by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, banding, exact verification.

1. Every document becomes a multiset of five-word shingles. Documents with equal multisets are one node from here on.
2. A signature of REGISTERS values per node; equal values have the probability of the weighted Jaccard similarity.
3. Bands of ROWS values put nodes into buckets. In each bucket every node is compared with two leaders: the most central node
   (the one that shares most buckets with others: in a group of edited copies, the original) and a random one.
4. Pairs are verified by the multiset overlap itself; linked nodes form classes (connected components).
5. Buckets whose nodes still lie in several classes are gone through again: all pairs of different classes where the bucket has at
   most SMALL nodes, else every node against the most central one outside the bucket's largest class; up to ROUNDS times,
   while that finds links. This only merges classes cheaply.
6. What is left of the buckets above SMALL is settled exactly: a prefix-filter join on each node's rarest elements gives every
   pair of different classes that can be near, and those pairs are verified.

Defined results: texts without a word are classes of their own; texts of one to four words have one shingle, the whole
text; repeated rows are exact copies; a null id never becomes a class id while the class has another one; of equal ids in a class
the row with the least key stays; very long texts are signed whole; an empty table gives no classes. Elements are 32-bit
hashes of shingles and occurrences: two of n elements fall together with a probability of about n * n / 2**33, which can
move the similarity of a pair by one element.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, materialise, tokens

SHINGLE, SIMILARITY = 5, 0.8
REGISTERS, ROWS = 64, 4
SMALL, ROUNDS = 32, 3
#: Cells in which elements are counted for their order in the prefix-filter join.
CELLS, BLOCKS = 1 << 20, 256
#: Shingles that are signed at once in a task.
CHUNK = 100_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


class WordHash:
    """64-bit hashes of words; those seen are kept, up to a bound."""

    def __init__(self, most: int = 300_000) -> None:
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = [known.get(w) for w in words]
        for i, (w, h) in enumerate(zip(words, out, strict=True)):
            if h is None:
                out[i] = known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array(out, dtype=np.uint64)


def bag(text: str | None, word_hash: WordHash, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their counts."""
    ws = tokens(text or "")
    if not ws:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = word_hash(ws)
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(h))):
            out = out * _U(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mix(out), return_counts=True)


def bag_min_hash(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """A row of registers per multiset; infinite where the multiset is empty.

    Each element has a Poisson process over (time, height). Heights are split into dyadic levels [0,1), [1,2), [2,4) ...; a level
    is started only if the element's count reaches into it, and its points above the count are passed over. A register holds the
    earliest point that falls to it. Points come in order of time, so an element stops once it is later than the
    latest register of its multiset: most elements need one or two points.
    """
    out = np.full((len(bags), registers), np.inf)
    parts = []
    for d, (h, c) in enumerate(bags):
        level = 0
        while len(h):
            parts.append((np.full(len(h), d), h, c, np.full(len(h), level)))
            keep = c > 2**level
            h, c, level = h[keep], c[keep], level + 1
    if not parts:
        return out
    doc, h, count, level = (np.concatenate(x) for x in zip(*parts, strict=True))
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    span = np.maximum(low, 1.0)
    with np.errstate(over="ignore"):
        state = mix(h ^ mix(level.astype(np.uint64) + _U(0x51ED270B)))
    time = np.zeros(len(h))
    flat = out.reshape(-1)
    while len(doc):
        with np.errstate(over="ignore"):
            state = state + _U(0x9E3779B97F4A7C15)
        a = mix(state)
        b = mix(a ^ _U(0xD6E8FEB86659FD93))
        time = time - np.log(uniform(a)) / (registers * span)
        hit = low + span * uniform(mix(b)) < count
        np.minimum.at(flat, doc[hit] * registers + (b[hit] % _U(registers)).astype(np.int64), time[hit])
        go = time < out.max(axis=1)[doc]
        if not go.all():
            doc, count, low, span, state, time = doc[go], count[go], low[go], span[go], state[go], time[go]
    return out


def bands_of(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band, different for different bands."""
    bits = signature.view(np.uint64)
    n = bits.shape[1] // rows
    key = np.zeros((len(bits), n), np.uint64) + np.arange(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key * _U(0x9E3779B97F4A7C15) + bits[:, r::rows][:, :n])
    return key.view(np.int64)


def elements(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The multiset as a set of 32-bit numbers: one per shingle and occurrence."""
    with np.errstate(over="ignore"):
        repeated = np.repeat(h, c)
        nth = np.arange(len(repeated)) - np.repeat(np.cumsum(c) - c, c)
        return np.unique(mix(repeated + nth.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)).astype(np.uint32)).view(np.int32)


def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    word_hash = WordHash()
    for batch in batches:
        start, bags, held = 0, [], 0
        for k, text in enumerate(batch["text"]):
            bags.append(bag(text, word_hash))
            held += len(bags[-1][0])
            if held >= CHUNK or k + 1 == len(batch):
                part = batch.iloc[start : k + 1]
                bands = bands_of(bag_min_hash(bags))
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(),
                    "row_key": part["row_key"].to_numpy(),
                    "node": [xxhash.xxh3_128_digest(h.tobytes() + c.tobytes()) if len(h) else None for h, c in bags],
                    "bands": [b if len(h) else None for b, (h, _) in zip(bands, bags, strict=True)],
                    "elements": [elements(h, c) if len(h) else None for h, c in bags],
                })
                start, bags, held = k + 1, [], 0


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.md5(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, node (null without a word), bands, elements: written to the shared folder."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(docs, id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return materialise(slim.mapInPandas(sign, "doc_id bigint, row_key string, node binary, bands array<bigint>, elements array<int>"), "neardup-signatures")


def verified(pairs: DataFrame, known: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough. known: node, elements, one row each."""
    x = pairs.join(known.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a").join(known.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    x = x.where(F.least(F.size("ea"), F.size("eb")) >= similarity * F.greatest(F.size("ea"), F.size("eb")))
    x = x.withColumn("common", F.size(F.array_intersect("ea", "eb")))
    return materialise(x.where(F.col("common") >= similarity * (F.size("ea") + F.size("eb") - F.col("common"))).select("a", "b"), "neardup-links")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component, for nodes with a link.

    Minimum labels travel along the links, then each label takes the label of its own node, until nothing changes.
    """
    both = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "neardup-both")
    label = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), "neardup-label")
    while True:
        near = both.join(label.select(F.col("node").alias("u"), "label"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = materialise(step.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "neardup-label")
        label = step.select("node", "label")
        if not step.where("label != old").limit(1).count():
            return label


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, label) with the classes that further links (a, b) join. Classes, not nodes, are the nodes of this second graph, so each pair of
    classes counts once, however many links it has."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    known = materialise(ends.join(label, "node", "full").select("node", F.coalesce("label", "node").alias("label")), "neardup-label")
    side = lambda x: known.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    pairs = materialise(pairs_of(links.join(side("a"), "a").join(side("b"), "b"), "la", "lb"), "neardup-classes")
    roots = components(pairs).select(F.col("node").alias("label"), F.col("label").alias("root"))
    return materialise(known.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "neardup-label")


def pairs_of(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def unsettled(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (a, b) still to be compared in buckets with nodes of several classes; at most SMALL for each node and bucket."""
    inside = buckets.join(label, "node", "left").select("bucket", "node", "n", "central", F.coalesce("label", "node").alias("label"))
    classes = inside.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.max(F.struct("central", "node")).alias("best"))
    most = classes.groupBy("bucket").agg(F.count("*").alias("classes"), F.max(F.struct("k", "label")).alias("top")).where("classes > 1").select("bucket", F.col("top.label").alias("top"))
    open_ = materialise(inside.join(most, "bucket"), "neardup-open")
    little = open_.where(F.col("n") <= SMALL)
    x, y = little.where("label != top").select("bucket", F.col("node").alias("x"), F.col("label").alias("lx")), little.select("bucket", F.col("node").alias("y"), F.col("label").alias("ly"))
    small = pairs_of(x.join(y, "bucket").where("lx != ly"), "x", "y")
    large = open_.where(F.col("n") > SMALL)
    second = large.where("label != top").groupBy("bucket").agg(F.max(F.struct("central", "node", "label")).alias("lead")).select("bucket", F.col("lead.node").alias("lead"), F.col("lead.label").alias("lead_label"))
    wide = large.join(second, "bucket").where("label != lead_label")
    return small.unionByName(pairs_of(wide, "node", "lead")).distinct()


def prefix(e: np.ndarray, rarity: np.ndarray, similarity: float) -> np.ndarray:
    """The elements of a set that a near set must share one of, rarest first."""
    return e[np.lexsort((e, rarity[e % CELLS]))][: len(e) - math.ceil(similarity * len(e) - 1e-9) + 1]


def cell_counts(sets: DataFrame, rarity: Broadcast | None = None, similarity: float = SIMILARITY) -> Broadcast:
    """How many elements of the sets (with a rarity, of their prefixes) fall into each of CELLS cells. Tasks count what they have; their tables are added
    up in BLOCKS pieces, and one table of CELLS numbers reaches the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(CELLS, np.int64)
        for batch in batches:
            for e in map(np.asarray, batch["elements"]):
                np.add.at(sums, (e if rarity is None else prefix(e, rarity.value, similarity)) % CELLS, 1)
        pieces = sums.reshape(BLOCKS, -1)
        used = np.flatnonzero(pieces.any(axis=1))
        yield pd.DataFrame({"block": used, "counts": [zlib.compress(pieces[b].tobytes(), 1) for b in used]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS // BLOCKS, np.int64)
        for raw in parts["counts"]:
            total += np.frombuffer(zlib.decompress(raw), np.int64)
        return pd.DataFrame({"block": parts["block"][:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    kind = "block bigint, counts binary"
    counts = np.zeros((BLOCKS, CELLS // BLOCKS), np.int32)
    for r in sets.select("elements").mapInPandas(count, kind).groupBy("block").applyInPandas(add, kind).collect():  # BLOCKS rows at most
        counts[r.block] = np.minimum(np.frombuffer(zlib.decompress(r.counts), np.int64), 2**31 - 1)
    return sets.sparkSession.sparkContext.broadcast(counts.ravel())


def prefixes(each: DataFrame, rarity: Broadcast, wanted: Broadcast, similarity: float) -> DataFrame:
    """node, label, outside, size, prefix, at: the prefix of each node, and the places of what may be shared: all for outside nodes, for inside ones
    those whose cell an outside node's prefix has."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.asarray(e) for e in batch["elements"]]
            parts = [prefix(e, rarity.value, similarity) for e in sets]
            at = [np.arange(len(p)) if outside else np.flatnonzero(wanted.value[p % CELLS]) for p, outside in zip(parts, batch["outside"], strict=True)]
            yield batch[["node", "label", "outside"]].assign(size=[len(e) for e in sets], prefix=parts, at=at)

    return each.mapInPandas(cut, "node binary, label binary, outside boolean, size int, prefix array<int>, at array<int>")


def prefix_pairs(buckets: DataFrame, label: DataFrame, known: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of different classes among the nodes of open buckets above SMALL: all those that can be near.

    Sets with a Jaccard similarity of s share an element among the first n - ceil(s n) + 1 of each in one order; with the rarest
    first, few others do. How rare an element is comes from counts in CELLS cells: any order gives all pairs, so a table of fixed size does,
    and elements are neither counted one by one nor joined with their counts. One side of each pair lies outside the largest class of a bucket, so
    the nodes inside list only elements of a cell that an outside node's prefix has.
    """
    inside = buckets.where(F.col("n") > SMALL).join(label, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    most = inside.groupBy("bucket", "label").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.count("*").alias("classes"), F.max(F.struct("k", "label")).alias("top")).where("classes > 1").select("bucket", F.col("top.label").alias("top"))
    nodes = materialise(inside.join(most, "bucket").groupBy("node", "label").agg(F.max(F.col("label") != F.col("top")).alias("outside")), "neardup-outside")
    each = materialise(known.join(nodes, "node").select("node", "label", "outside", "elements"), "neardup-settled")
    rarity = cell_counts(each)
    wanted = cell_counts(each.where("outside"), rarity, similarity)
    # Each row knows its node's prefix and its place there: two nodes meet at the first element they share alone.
    cuts = prefixes(each, rarity, wanted, similarity).where(F.size("at") > 0).withColumn("place", F.explode("at")).withColumn("element", F.get("prefix", F.col("place")))
    placed = materialise(cuts.drop("at"), "neardup-prefixes")
    side = lambda x: placed.select("element", "outside", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "size", "place", "prefix")])
    pairs = side("x").where("outside").drop("outside").join(side("y").drop("outside"), "element").where("label_x != label_y")
    sizes = F.col("size_x"), F.col("size_y")
    # The first shared element bounds the overlap by what comes after it.
    ahead = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    pairs = pairs.where(~F.arrays_overlap(F.slice("prefix_x", F.lit(1), F.col("place_x")), F.slice("prefix_y", F.lit(1), F.col("place_y"))))
    pairs = pairs.where((F.least(*sizes) >= similarity * F.greatest(*sizes) - 1e-9) & ((1 + similarity) * ahead >= similarity * (sizes[0] + sizes[1]) - 1e-9))
    return pairs_of(pairs, "node_x", "node_y")


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, row_key, class_key, class_id, class_size for every row; a, b for the verified links."""
    signed = signatures(docs, id_col, text_col)
    bands = signed.where("node is not null").select("node", F.explode("bands").alias("bucket")).distinct()
    full = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialise(bands.join(full, "bucket"), "neardup-buckets")
    central = buckets.groupBy("node").agg(F.sum("n").alias("central"))
    buckets = materialise(buckets.join(central, "node"), "neardup-buckets")
    leaders = buckets.groupBy("bucket").agg(F.array_distinct(F.array(F.max(F.struct("central", "node")).getField("node"), F.min(F.struct(F.xxhash64("node"), "node")).getField("node"))).alias("leaders"))
    stars = buckets.join(leaders, "bucket").select("node", F.explode("leaders").alias("leader"))
    tested = materialise(pairs_of(stars, "node", "leader"), "neardup-stars")
    # Elements of nodes with a neighbour, one row each: the one time that elements are shuffled whole, at every size in the same way.
    firsts = signed.join(buckets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("first_key"))
    known = signed.join(firsts.hint("merge"), "node").where("row_key = first_key").select("node", "elements").dropDuplicates(["node"])
    known = materialise(known, "neardup-elements")
    links = verified(tested, known, similarity)
    label = components(links)
    for _ in range(ROUNDS):
        rest = materialise(unsettled(buckets, label).join(tested, ["a", "b"], "left_anti"), "neardup-rest")
        if not rest.limit(1).count():
            break
        new = verified(rest, known, similarity)
        tested = tested.unionByName(rest)
        if not new.limit(1).count():
            break
        links = links.unionByName(new)
        label = joined(label, new)
    rest = materialise(prefix_pairs(buckets, label, known, similarity).join(tested, ["a", "b"], "left_anti"), "neardup-rest")
    if rest.limit(1).count():
        new = verified(rest, known, similarity)
        if new.limit(1).count():
            links = links.unionByName(new)
            label = joined(label, new)
    members = signed.select("doc_id", "row_key", "node").join(label, "node", "left")
    members = members.select("doc_id", "row_key", F.coalesce(F.hex(F.coalesce("label", "node")), F.concat(F.lit("-"), "row_key")).alias("class_key"))
    ids = members.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct("doc_id", "row_key")).alias("least"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row_key"))).alias("known"))
    ids = ids.withColumn("keep", F.coalesce("known", "least").getField("row_key")).drop("least", "known")
    return members.join(ids, "class_key"), links


def dedup(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with its own columns: the one with the least id (of repeated rows, one).

    Texts without a word have a class each; of repeated rows of such a text (same id) one stays too.
    """
    members, _ = near_duplicate_classes(docs, similarity, id_col, text_col)
    key, nth = free_name(docs, "row_key"), free_name(docs, "nth_row")
    stay = members.where("row_key = keep").select(F.col("row_key").alias(key)).distinct()
    out = docs.withColumn(key, row_key(docs, id_col, text_col)).join(stay, key, "left_semi")
    order = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes])
    return out.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col(nth) == 1).drop(key, nth)
