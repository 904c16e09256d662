"""Spelling variants: exact neighbours at one edit from pairs of trie nodes, and the common form that each rare spelling leads to.

1. Words are counted over whole texts. Sorted, they are the trie's preorder: a task walks one stretch of them and numbers a node where
   its prefix first occurs; nodes that reach over the border of two stretches get their number before, from the words at the borders.
   The same over reversed words numbers the suffixes.
2. Each word lists its integer pairs (prefix node, suffix node) around every skipped position and around every gap. Words that skip
   a position between equal nodes differ by a replacement; one that skips where another has a gap, by an insertion. A run of
   equal letters counts at its first place alone, so each two neighbours meet once.
3. A pair of nodes has no more words than the alphabet has letters (90 and one), whatever the size of the dictionary. They are counted
   and ranked under their pair; pairs of words are never listed.
4. A form has at least `factor` times the word's count, so chains are short: their length is bounded by the largest count.

Defined results: null and empty texts have no words; a null doc_id counts as empty text in the key; repeated rows count each; equal
counts give the smallest word in code-point order; no rows give no words; words of any length are walked once; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, materialise

LEAST_LENGTH, LEAST_COUNT, FACTOR, EVERY = 7, 2, 10, 31
#: Words that one task walks.
PART_WORDS = 20_000
LETTERS = r"[A-Za-zÀ-ÿ]"


def dictionary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, one code point left out where `every` divides the run's hash (0: never)."""
    # A shorter run gives no word, deleted or not.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("run"))
    run = F.col("run")
    runs = runs.select("id", F.when(F.lower(run) == run, run).otherwise(ascii_lower(run)).alias("run"))
    word = run
    if every:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length(run)).cast("int")
        word = F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)
    words = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def borders(bounds: Iterable[tuple[int, str, str]]) -> list[tuple]:
    """For each stretch (part, first word, last word), in order: part, the prefix it shares with the stretch before and that prefix' node numbers,
    the same for the stretch after. These nodes have negative numbers; one that reaches over several borders keeps its number."""
    bounds = list(bounds)
    shared: list[tuple[str, list[int]]] = [("", [])]
    made = 0
    for (_, _, high), (_, low, _) in zip(bounds, bounds[1:], strict=False):
        text, (before, numbers) = high[: common(high, low)], shared[-1]
        kept = numbers[: common(before, text)]
        fresh = len(text) - len(kept)
        shared.append((text, kept + [-made - i for i in range(1, fresh + 1)]))
        made += fresh
    shared.append(("", []))
    return [(part, *shared[i], *shared[i + 1]) for i, (part, _, _) in enumerate(bounds)]


def walk(words: Iterable[str], base: int, sides: list[tuple[str, list[int]]]) -> Iterator[list[int]]:
    """Node numbers from the root (0) to the end of each word, words ascending; new numbers follow base."""
    before, path = "", [0]
    for w in words:
        del path[common(before, w) + 1 :]
        for text, numbers in sides:
            path += numbers[len(path) - 1 : common(text, w)]
        while len(path) <= len(w):
            base += 1
            path.append(base)
        before = w
        yield list(path)


def trie_paths(words: DataFrame, key: str, parts: int) -> DataFrame:
    """words with rank (its place in the order of `key`, with gaps) and path (the trie's node numbers along `key`); keys are distinct."""
    spark = words.sparkSession
    d = materialise(words.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()), "spelling-parts")
    # One row per stretch, not per word.
    bounds = d.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).orderBy("part").collect()
    sides = spark.createDataFrame(borders([(r.part, r.low, r.high) for r in bounds]), "part int, left string, left_numbers array<bigint>, right string, right_numbers array<bigint>")

    def number(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, ignore_index=True)
        for s in side.itertuples():
            base = (int(s.part) + 1) << 32
            rows["rank"] = range(base, base + len(rows))
            rows["path"] = list(walk(rows[key], base, [(s.left, list(s.left_numbers)), (s.right, list(s.right_numbers))]))
        return rows

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name != "part")
    return d.groupBy("part").cogroup(sides.groupBy("part")).applyInPandas(lambda a, b: number(a, b).drop(columns="part"), f"{fields}, rank bigint, path array<bigint>")


def node_pairs(words: DataFrame) -> DataFrame:
    """word, n, rank and an array of (p, s, kind) for every word of a dictionary (word, n). kind: 2 a gap, 1 a skipped position, 0 one that
    skips the same letter as the place before."""
    parts = max(1, -(-words.count() // PART_WORDS))
    forward = trie_paths(words, "word", parts)
    backward = trie_paths(words.select(F.reverse("word").alias("reversed")), "reversed", parts).select(F.reverse("reversed").alias("word"), F.col("path").alias("back"))
    size, letters = F.size("path") - 1, F.split("word", "")
    d = forward.join(backward, "word").withColumn("letters", letters).withColumn("size", size)
    pair = lambda i, j, kind: F.struct(F.col("path")[i].alias("p"), F.col("back")[j].alias("s"), kind.cast("int").alias("kind"))
    first = lambda i: (i == 0) | (F.col("letters")[i] != F.col("letters")[F.greatest(i - 1, F.lit(0))])
    gaps = F.transform(F.sequence(F.lit(0), F.col("size")), lambda i: pair(i, F.col("size") - i, F.lit(2)))
    skips = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: pair(i, F.col("size") - 1 - i, F.when(first(i), 1).otherwise(0)))
    return d.select("word", "n", "rank", F.concat(gaps, skips).alias("pairs"))


def neighbours(pairs: DataFrame) -> DataFrame:
    """rank, n_near, best (n and negated rank of the most frequent word at one edit; may be the word itself if none has more)."""
    w = Window.partitionBy("p", "s")
    d = pairs.select("rank", "n", F.inline("pairs"))
    own, skip, gap = F.struct("n", (-F.col("rank")).alias("back")), F.col("kind") < 2, F.col("kind") == 2
    d = d.select(
        "rank", "kind", F.count_if(skip).over(w).alias("skips"), F.count_if(F.col("kind") == 1).over(w).alias("firsts"), F.count_if(gap).over(w).alias("gaps"),
        F.max(F.when(skip, own)).over(w).alias("best_skip"), F.max(F.when(gap, own)).over(w).alias("best_gap"),
    )
    near = F.when(gap, F.col("firsts")).when(F.col("kind") == 1, F.col("skips") - 1 + F.col("gaps")).otherwise(F.col("skips") - 1)
    best = F.when(gap, F.col("best_skip")).otherwise(F.greatest("best_skip", "best_gap"))
    return d.select("rank", near.alias("near"), best.alias("best")).groupBy("rank").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def last_forms(links: DataFrame, most: int, factor: int) -> DataFrame:
    """rank, root: where following links (rank, form) ends. Counts grow by `factor` a step and start at 1 or more, so `most` bounds the steps."""
    out = links.select("rank", F.col("form").alias("root"))
    for _ in range(math.floor(math.log(max(1, most), factor))):
        step = links.select(F.col("rank").alias("root"), F.col("form").alias("further"))
        out = out.join(step, "root", "left").select("rank", F.coalesce("further", "root").alias("root"))
    return out


def group_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, every: int = EVERY) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of docs (doc_id, text)."""
    words = materialise(dictionary(docs, least_length, least_count, every), "spelling-words")
    pairs = materialise(node_pairs(words), "spelling-pairs")
    near = neighbours(pairs).withColumn("form", -F.col("best.back")).withColumn("form_n", F.col("best.n")).drop("best")
    d = pairs.select("word", "n", "rank").join(near, "rank")
    far = F.col("form_n") >= factor * F.col("n")
    d = materialise(d.select("word", "n", "rank", "n_near", F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n")), "spelling-near")
    most = words.agg(F.max("n")).first()[0] or 1
    roots = last_forms(d.where("form is not null").select("rank", "form"), most // max(1, least_count), factor)
    name = lambda key, out: d.select(F.col("rank").alias(key), F.col("word").alias(out))
    led = d.where("form is not null").drop("n_near").join(roots, "rank").join(name("form", "form_word"), "form").join(name("root", "root_word"), "root")
    led = led.select("word", "n", "form_n", "form_word", "root_word").join(d.where("form is not null").select("word", "n_near"), "word")
    rest = d.where("form is null").select("word", "n", "n_near", F.lit(None).cast("string").alias("form"), F.lit(None).cast("bigint").alias("form_n"), F.col("word").alias("root"))
    return led.select("word", "n", "n_near", F.col("form_word").alias("form"), "form_n", F.col("root_word").alias("root")).unionByName(rest)


#: DuckDB SQL for crc32: its table, and the value of a string column.
_STEP = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
CRC_TABLE = ", ".join(["crc0 as (select range::bigint as i, range::bigint as c from range(256))", *[f"crc{k} as (select i, {_STEP} as c from crc{k - 1})" for k in range(1, 9)], "crc as materialized (select list(c order by i) as crc_table from crc8)"])
CRC = "xor(4294967295, list_reduce(list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), (2 * i + 1)::int, 2))::bigint), lambda c, x: xor(c >> 8, crc_table[xor(c, x) & 255 + 1]), 4294967295))".replace("xor(c, x) & 255 + 1", "(xor(c, x) & 255) + 1")

ORACLE = rf"""with recursive {CRC_TABLE},
raw as (select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
once as (select id, run, count(*) as k, id || ':' || run as keyed from raw group by id, run),
hashed as (select run, k, {CRC.format("keyed")} as h from once, crc),
made as (select k, case when h % {EVERY} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed),
w as materialized (select word, sum(k)::bigint as n from made where length(word) >= {LEAST_LENGTH} group by word having sum(k) >= {LEAST_COUNT}),
cut as materialized (select word, n, i, substr(word, 1, i::int) || '_' || substr(word, i::int + 2) as hole, substr(word, 1, i::int) || substr(word, i::int + 2) as short from (select word, n, unnest(range(length(word))) as i from w)),
pair as (select a.word, b.word as near, b.n as near_n from cut a join cut b on a.hole = b.hole and a.word <> b.word union select c.word, w.word, w.n from cut c join w on c.short = w.word union select w.word, c.word, c.n from cut c join w on c.short = w.word),
ranked as (select *, row_number() over (partition by word order by near_n desc, near) as place, count(*) over (partition by word) as n_near from pair),
best as materialized (select w.word, w.n, coalesce(r.n_near, 0)::bigint as n_near, case when r.near_n >= {FACTOR} * w.n then r.near end as form, case when r.near_n >= {FACTOR} * w.n then r.near_n end as form_n from w left join ranked r on r.word = w.word and r.place = 1),
chain as (select word, word as last from best union all select c.word, b.form from chain c join best b on b.word = c.last where b.form is not null)
select b.word, b.n, b.n_near, b.form, b.form_n, c.last as root from best b join chain c on c.word = b.word join best e on e.word = c.last where e.form is null"""
