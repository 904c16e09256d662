"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND by every passage.

The benchmark is the indexed side, the corpus is the query side. Terms are pairs of neighbouring words,
so that common words alone do not make candidates. Every posting weight is the BM25 impact divided by the
item's score against itself; one threshold then means the same for long and short items.

The index is broadcast in shards of a bounded number of postings, one at a time; a larger benchmark gives more shards, each of which
goes through the corpus once more and adds its hits to those written before. Nothing of the corpus is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, materialise, tokens

#: Most postings in one broadcast shard (about 60 bytes each as Python objects and arrays).
SHARD_POSTINGS = 500_000
K1, B = 1.2, 0.75
BLOCK = 8
#: Least normalised BM25 score of a candidate, and least share of question and answer found in the passage.
THRESHOLD, OVERLAP = 0.5, 0.8
#: Least words between two passage starts; passages are twice as long.
STRIDE = 64

HITS = "array<struct<item_id:bigint,passage_start:bigint,score:double,question_overlap:double,answer_overlap:double>>"

def split_answer(text: str) -> tuple[int, int]:
    """Words of the question and of the answer. The answer is the last sentence, or the last quarter of a single one."""
    n = len(tokens(text))
    ends = [m.end() for m in re.finditer(r"[.!?]+\s+", text.rstrip())]
    q = len(tokens(text[: ends[-1]])) if ends else 0
    if not 0 < q < n:
        q = n - max(1, n // 4)
    return (q, n - q) if n > 1 else (n, 0)


@dataclass
class Index:
    """One shard: posting lists by term, sorted by item, with a maximum per list and per block of BLOCK items."""

    words: dict[bytes, int]
    keys: np.ndarray
    lists: list[tuple[list[int], list[float], list[float]]]
    most: np.ndarray
    items: list[tuple[int, list[bytes], int]]
    stride: int
    threshold: float = THRESHOLD
    overlap: float = OVERLAP
    size: int = field(default=0)


def build_index(rows: list[tuple[int, str]], n_items: int, mean_length: float, df: dict[tuple[bytes, bytes], int], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Index:
    """Index of one bounded shard; n_items, mean_length and df are those of the whole benchmark."""
    words: dict[bytes, int] = {}
    items: list[tuple[int, list[bytes], int]] = []
    for item_id, text in sorted(rows, key=lambda r: (len(r[1]), r[0])):  # neighbours of like length: tight block maxima
        if ws := tokens(text):
            items.append((item_id, ws, split_answer(text)[0]))
            for w in ws:
                words.setdefault(w, len(words) + 1)
    postings: dict[int, list[tuple[int, float]]] = {}
    v = len(words) + 1
    for k, (_, ws, _) in enumerate(items):
        terms = Counter(zip(ws, ws[1:] or [b""], strict=False))
        length = max(1, len(ws) - 1)
        own = {t: math.log1p((n_items - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean_length)) for t, f in terms.items()}
        total = sum(own.values())
        for (a, b), x in own.items():
            postings.setdefault(words[a] * v + words.get(b, 0), []).append((k, x / total))
    keys = np.array(sorted(postings), dtype=np.int64)
    lists = []
    for key in keys.tolist():
        at, weights = map(list, zip(*postings[key], strict=True))
        best: dict[int, float] = {}
        for k, x in zip(at, weights, strict=True):
            best[k // BLOCK] = max(best.get(k // BLOCK, 0.0), x)
        lists.append((at, weights, best))
    most = np.array([max(x[1]) for x in lists])
    stride = max([STRIDE, *(len(ws) for _, ws, _ in items)])
    return Index(words, keys, lists, most, items, stride, threshold, overlap, len(keys))


def block_max_wand(index: Index, terms: list[int]) -> list[tuple[int, float]]:
    """All (item, score) with a score of at least the threshold, for a passage with these distinct terms."""
    found, theta, last = [], index.threshold, len(index.items)
    lists = [(*index.lists[t], float(index.most[t])) for t in terms]
    at = [0] * len(lists)
    order = sorted(range(len(lists)), key=lambda i: lists[i][0][0])

    def seek(i: int, item: int) -> None:
        ids, k = lists[i][0], at[i]
        while k < len(ids) and ids[k] < item:
            k += 1
        at[i] = k

    while order:
        total, pivot = 0.0, None
        for n, i in enumerate(order):
            total += lists[i][3]
            if total >= theta - 1e-12:
                pivot = lists[i][0][at[i]]
                while n + 1 < len(order) and lists[order[n + 1]][0][at[order[n + 1]]] == pivot:
                    n += 1
                break
        if pivot is None:
            break
        ahead = order[: n + 1]
        block = pivot // BLOCK
        if sum(lists[i][2].get(block, 0.0) for i in ahead) < theta - 1e-12:
            # No item of this block up to where the next list begins can reach the threshold.
            stop = (block + 1) * BLOCK
            if n + 1 < len(order):
                stop = min(stop, lists[order[n + 1]][0][at[order[n + 1]]])
            target = max(stop, pivot + 1)
        elif lists[order[0]][0][at[order[0]]] == pivot:
            score = sum(lists[i][1][at[i]] for i in ahead)
            if score >= theta - 1e-12:
                found.append((pivot, score))
            target = pivot + 1
        else:
            target = pivot
        for i in ahead:
            seek(i, target)
        if target > last:
            break
        order = sorted((i for i in order if at[i] < len(lists[i][0])), key=lambda i: lists[i][0][at[i]])
    return found


def verify(index: Index, item: int, passage: list[bytes]) -> tuple[float, float]:
    """Shares of the item's question and answer words that stand in the passage, in order, in runs of two or more."""
    _, ws, q = index.items[item]
    hit = np.zeros(len(ws), dtype=bool)
    least = 2 if len(ws) > 1 else 1
    for m in SequenceMatcher(None, ws, passage, autojunk=False).get_matching_blocks():
        if m.size >= least:
            hit[m.a : m.a + m.size] = True
    return float(hit[:q].mean()) if q else 1.0, float(hit[q:].mean()) if q < len(ws) else 1.0


def search(index: Index, text: str | None) -> list[tuple[int, int, float, float, float]]:
    """Verified hits of one document: (item_id, first word of the passage, score, question and answer overlap), the best passage of each item."""
    ws = tokens(text or "")
    if not ws or not index.size:
        return []
    get, v, step = index.words.get, len(index.words) + 1, index.stride
    ids = np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws))
    pair = np.flatnonzero(ids)
    key = ids[pair] * v + np.append(ids, 0)[pair + 1]
    term = np.minimum(np.searchsorted(index.keys, key), index.size - 1)
    same = index.keys[term] == key
    at, term = pair[same], term[same]
    if not len(at):
        return []
    # WAND's pivot test over all passages at once: distinct terms of each stretch, then of two neighbouring ones.
    cell_term = np.unique(at // step * index.size + term)
    cell, term = cell_term // index.size, cell_term % index.size
    n_cells = (len(ws) - 1) // step + 1
    bound = np.bincount(cell, weights=index.most[term], minlength=n_cells + 1)
    window = bound[:-1] + bound[1:]
    best: dict[int, tuple[int, int, float, float, float]] = {}
    for w in np.flatnonzero(window >= index.threshold - 1e-9).tolist():
        lo, hi = np.searchsorted(cell, [w, w + 2])
        passage = ws[w * step : (w + 2) * step]
        for item, score in block_max_wand(index, np.unique(term[lo:hi]).tolist()):
            item_id = index.items[item][0]
            q, a = verify(index, item, passage)
            if q >= index.overlap and a >= index.overlap and (item_id not in best or score > best[item_id][2]):
                best[item_id] = (item_id, w * step, score, q, a)
    return sorted(best.values())


def index_shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_postings: int = SHARD_POSTINGS):
    """Yield the shards of the index. Statistics (items, mean length, document frequencies) cover the whole benchmark; they
    are counted in Spark, and each shard takes only its own items and frequencies to the driver."""

    @F.pandas_udf("struct<length:int,terms:array<binary>>")
    def measured(texts: pd.Series) -> pd.DataFrame:
        split = [tokens(t) for t in texts]
        # No word holds a space.
        pairs = [list({a + b" " + b for a, b in zip(ws, ws[1:] or [b""], strict=False)}) for ws in split]
        return pd.DataFrame({"length": [max(1, len(ws) - 1) for ws in split], "terms": pairs})

    base = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates()
    base = materialise(base.withColumn("m", measured("text")).select("item_id", "text", "m.*"), "benchmark")
    terms = base.select("item_id", "text", F.explode("terms").alias("term"))
    total, postings, mean = base.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.coalesce(F.avg("length"), F.lit(1.0))).first()
    shards = max(1, math.ceil(postings / shard_postings))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    for s in range(shards):
        mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s
        rows = [(r.item_id, r.text) for r in base.where(mine).select("item_id", "text").collect()]
        own = terms.where(mine).select("term").distinct().join(df, "term")
        counts = {tuple(bytes(r.term).split(b" ")): r.df for r in own.collect()}
        yield build_index([r for r in rows if r[0] is not None], total, mean, counts, threshold, overlap)


def searcher(shared):
    """The column function that searches one broadcast shard."""
    names = ("item_id", "passage_start", "score", "question_overlap", "answer_overlap")

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, h, strict=True)) for h in search(shared.value, t)] for t in texts], dtype=object)

    return hits


def find_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", out: str = "hits", **options) -> DataFrame:
    """docs with one more column: verified benchmark hits (array of struct, empty for clean documents).

    Null and empty texts have no hits; items without a word match nothing; equal items (id and text) count once; items with a
    null id are left out; repeated documents each get their own hits; an existing column named `out` is replaced; an empty table gives
    no rows; very long texts are searched whole, passage by passage; of passages with the same score the first one is reported.
    """
    spark, found = docs.sparkSession, None
    for index in index_shards(items, **options):
        if not index.size:
            continue
        if found is not None:
            # The hits so far are written, so that no task ever holds two shards.
            docs, last = materialise(docs.withColumn(out, found), "hits"), shared
            last.destroy()
        shared = spark.sparkContext.broadcast(index)
        hits = searcher(shared)(F.col(text_col))
        found = hits if found is None else F.concat(F.col(f"`{out}`"), hits)
    return docs.withColumn(out, F.array().cast(HITS) if found is None else found)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a verified benchmark hit, with their own columns."""
    name = free_name(docs, "hits")
    return find_hits(docs, items, out=name, **options).where(F.size(name) == 0).drop(name)
