"""Reversible line de-duplication: sharded cuckoo filters backed by exact tables of reference counts.

A state folder in shared storage holds, for each version,
  counts   key (128-bit hash of a line), old, n: the exact number of documents with that line before and after, for the keys that
           the version touched; every COMPACT versions a layer holds all keys;
  filters  shard, table: a cuckoo filter of the shard's keys with at least `min_docs` documents.
Inserting or deleting documents adds or subtracts their distinct keys, and only keys that cross `min_docs` are put into
or taken out of their shard's filter. Filters answer "surely not frequent": where the text is while they are small, else
lines are dealt to the filters by shard. Lines that they flag are confirmed against the counts, so results are exact.

Defined results: null and empty texts are one empty line; a key under `min_chars` code points never counts; repeated rows
are documents of their own; deleting what was never inserted raises no error but leaves a negative count in the table; very long
texts are split whole; an empty table gives no rows; apply() replaces columns named n_lines, n_dropped and kept_sha256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, materialise, new_folder

MIN_DOCS, MIN_CHARS = 10, 1
#: Keys per shard that are aimed at, slots per bucket, and the load at which a filter grows.
SHARD_KEYS, SLOTS, LOAD, KICKS = 50_000, 4, 0.85, 200
#: Most bytes of filters, or of confirmed keys, that are broadcast; beyond that lines go to them by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Versions between two whole tables of counts, and the parts into which the lines of a shard or key are dealt when they are shuffled.
COMPACT, SALTS = 8, 8
_STRIP = "\x20\x09\x0a\x0b\x0c\x0d"


def key_of(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    k = line.strip(_STRIP)
    return xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass").lower()) if len(k) >= min_chars else None


class CuckooFilter:
    """Fingerprints of 16 bits (0: free) in buckets of SLOTS; a key has two buckets, each found from the other and the fingerprint."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        n = 1
        while n * SLOTS * LOAD < max(1, keys):
            n *= 2
        return cls(np.zeros((n, SLOTS), np.uint16))

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, key: bytes) -> tuple[int, int, int]:
        f = int.from_bytes(key[4:6], "little") % 65535 + 1
        i = int.from_bytes(key[8:16], "little") & (len(self.table) - 1)
        return f, i, self._other(i, f)

    def _other(self, i: int, f: int) -> int:
        return (i ^ (f * 0x5BD1E995 >> 3)) & (len(self.table) - 1)

    def __contains__(self, key: bytes) -> bool:
        f, i, j = self._places(key)
        return f in self.table[i].tolist() or f in self.table[j].tolist()

    def insert(self, key: bytes) -> bool:
        f, i, j = self._places(key)
        for b in (i, j):
            for s in range(SLOTS):
                if not self.table[b, s]:
                    self.table[b, s] = f
                    return True
        moved, b = [], i
        for kick in range(KICKS):
            s = (f + kick) % SLOTS
            moved.append((b, s, int(self.table[b, s])))
            self.table[b, s], f = f, int(self.table[b, s])
            b = self._other(b, f)
            for s in range(SLOTS):
                if not self.table[b, s]:
                    self.table[b, s] = f
                    return True
        for b, s, old in reversed(moved):
            self.table[b, s] = old
        return False

    def delete(self, key: bytes) -> bool:
        f, i, j = self._places(key)
        for b in (i, j):
            for s in range(SLOTS):
                if self.table[b, s] == f:
                    self.table[b, s] = 0
                    return True
        return False

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        size = max(1, len(keys))
        while True:
            out = cls.sized(size)
            if all(out.insert(k) for k in keys):
                return out
            size = len(out.table) * SLOTS + 1


def shard_of(key: Column, shards: int) -> Column:
    """By the first four bytes of the key."""
    return F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long") % shards


def document_keys(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """key, n: the distinct keys of each document, counted (added up per batch before they are shuffled)."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: dict[bytes, int] = {}
            for text in batch["text"]:
                for k in {key_of(x, min_chars) for x in (text or "").split("\n")} - {None}:
                    n[k] = n.get(k, 0) + 1
            yield pd.DataFrame({"key": list(n), "n": list(n.values())})

    return docs.select(F.col(text_col).alias("text")).mapInPandas(keys, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class LineIndex:
    """A version of the state; insert() and delete() return the next one, and the old one stays readable."""

    spark: SparkSession
    folder: str
    version: int
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS
    #: Keys in the filters, and the version whose layer of counts holds all keys.
    frequent: int = 0
    base: int = 1

    @classmethod
    def empty(cls, spark: SparkSession, folder: str | None = None, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
        return cls(spark, folder or new_folder(spark, "lines"), 0, 0, min_docs, min_chars)

    @property
    def counts(self) -> DataFrame:
        """key, n of every key with a count: the newest layer that has it."""
        if not self.version:
            return self.spark.createDataFrame([], "key binary, n bigint")
        layers = [self.spark.read.schema("key binary, n bigint").parquet(f"{self.folder}/v{v}/counts").withColumn("layer", F.lit(v)) for v in range(self.base, self.version + 1)]
        out = layers[0]
        for x in layers[1:]:
            out = out.unionByName(x)
        if len(layers) > 1:
            out = out.groupBy("key").agg(F.max_by("n", "layer").alias("n"))
        return out.where("n != 0").select("key", "n")

    @property
    def filters(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], "shard bigint, table binary")
        return self.spark.read.schema("shard bigint, table binary").parquet(f"{self.folder}/v{self.version}/filters")

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._change(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._change(docs, text_col, -1)

    def _change(self, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
        path, least = f"{self.folder}/v{self.version + 1}", self.min_docs
        new = document_keys(docs, text_col, self.min_chars).select("key", (F.col("n") * sign).alias("change"))
        whole = self.version + 1 - self.base >= COMPACT
        if self.version:
            new = new.join(self.counts, "key", "full" if whole else "left")
        else:
            new = new.withColumn("n", F.lit(0).cast("bigint"))
        old = F.coalesce("n", F.lit(0))
        new = materialise(new.select("key", old.alias("old"), (old + F.coalesce("change", F.lit(0))).alias("n")), "lines", f"{path}/counts")
        crossed = new.where((F.col("n") >= least) != (F.col("old") >= least)).select("key", (F.col("n") >= least).alias("put"))
        frequent = self.frequent + (crossed.agg(F.sum(F.when(F.col("put"), 1).otherwise(-1))).first()[0] or 0)
        outgrown = self.shards == 0 or frequent > 2 * self.shards * SHARD_KEYS  # deal the keys out anew
        shards = max(1, -(-frequent // SHARD_KEYS)) if outgrown else self.shards
        out = LineIndex(self.spark, self.folder, self.version + 1, shards, self.min_docs, self.min_chars, frequent, self.version + 1 if whole or not self.version else self.base)
        at = shard_of(F.col("key"), shards).alias("shard")

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "table": [CuckooFilter.of(pdf["key"].tolist()).dump()]})

        def update(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            """The shard's next filter; null where it is full."""
            if left.empty:
                return build(right[right["put"]]) if right["put"].any() else pd.DataFrame({"shard": [], "table": []})
            f, full = CuckooFilter.load(left["table"].iloc[0]), False
            for k in right.loc[~right["put"].astype(bool), "key"]:
                f.delete(k)
            for k in right.loc[right["put"].astype(bool), "key"]:
                full = full or not f.insert(k)
            return pd.DataFrame({"shard": left["shard"].iloc[:1], "table": [None if full else f.dump()]})

        kind = "shard bigint, table binary"
        live = lambda: out.counts.where(F.col("n") >= least).select(at, "key")
        if outgrown:
            tables = live().groupBy("shard").applyInPandas(build, kind)
        else:
            tables = self.filters.groupBy("shard").cogroup(crossed.select(at, "key", "put").groupBy("shard")).applyInPandas(update, kind)
            tables = materialise(tables, "lines", f"{path}/updated")
            full = tables.where("table is null").select("shard")
            if full.limit(1).count():
                tables = tables.where("table is not null").unionByName(live().join(full, "shard", "left_semi").groupBy("shard").applyInPandas(build, kind))
        materialise(tables, "lines", f"{path}/filters")
        return out

    def _filter_bytes(self) -> int:
        return self.filters.agg(F.sum(F.length("table"))).first()[0] or 0

    def flagged_here(self, docs: DataFrame, text_col: str, out: str) -> DataFrame:
        """docs and an array of the keys of their lines that the filters, sent to all tasks, let through (null: none)."""
        tables = self.spark.sparkContext.broadcast({r.shard: r.table for r in self.filters.collect()})
        shards, min_chars = max(1, self.shards), self.min_chars

        @F.pandas_udf("array<binary>")
        def flag(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            filters = {s: CuckooFilter.load(t) for s, t in tables.value.items()}
            seen: dict[bytes, bool] = {}

            def passes(k: bytes) -> bool:
                if k not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    f = filters.get(int.from_bytes(k[:4], "big") % shards)
                    seen[k] = f is not None and k in f
                return seen[k]

            for batch in texts:
                yield pd.Series([[k for k in dict.fromkeys(key_of(x, min_chars) for x in (t or "").split("\n")) if k is not None and passes(k)] or None for t in batch], dtype=object)

        return docs.withColumn(out, flag(F.col(text_col)))

    def flagged_by_shard(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (key, text_key) that the filters let through: filters and keys meet by shard, and a task holds one filter at a time."""
        shards, names = max(1, self.shards), ["key", "text_key"]

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, f = None, None
            for batch in batches:
                keep = np.zeros(len(batch), bool)
                for i, (shard, table, key) in enumerate(zip(batch["shard"], batch["table"], batch["key"], strict=True)):
                    if table is not None:
                        at, f = shard, CuckooFilter.load(table)
                    else:
                        keep[i] = shard == at and key in f
                yield batch.loc[keep, names]

        salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("salt")
        filters = self.filters.select("shard", "table", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("text_key"), salts)
        lines = keys.select(shard_of(F.col("key"), shards).alias("shard"), F.lit(None).cast("binary").alias("table"), *names, F.pmod(F.xxhash64("text_key"), F.lit(SALTS)).cast("int").alias("salt"))
        both = filters.unionByName(lines).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("table").isNull())
        return both.mapInPandas(probe, "key binary, text_key string")

    def line_keys(self, docs: DataFrame, text_col: str) -> DataFrame:
        """key, text_key: the distinct keys of each distinct text."""
        min_chars = self.min_chars

        @F.pandas_udf("array<binary>")
        def keys(texts: pd.Series) -> pd.Series:
            return pd.Series([[k for k in {key_of(x, min_chars) for x in (t or "").split("\n")} if k is not None] for t in texts], dtype=object)

        return docs.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.explode(keys(F.col(text_col))).alias("key")).distinct().select("key", "text_key")

    def confirmed(self) -> DataFrame:
        return self.counts.where(F.col("n") >= self.min_docs).select("key")

    def frequent_keys(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The keys of the documents' lines that the filters let through, confirmed against the counts."""
        if self._filter_bytes() <= BROADCAST_BYTES:
            flagged = free_name(docs, "flagged_keys")
            keys = self.flagged_here(docs, text_col, flagged).where(F.col(flagged).isNotNull()).select(F.explode(flagged).alias("key")).distinct()
        else:
            own = document_keys(docs, text_col, self.min_chars).select("key", F.lit("").alias("text_key"))
            keys = self.flagged_by_shard(own).select("key")
        return materialise(keys.join(self.confirmed(), "key", "left_semi"), "lines-frequent")

    def apply(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with frequent lines taken out of the text, and n_lines, n_dropped, kept_sha256.

        The confirmed keys are sent to all tasks where they are few (BROADCAST_BYTES); else they are joined to the texts that have them.
        """
        min_chars, made, found, text_key = self.min_chars, free_name(docs, "kept_struct"), free_name(docs, "frequent"), free_name(docs, "text_key")
        certain = self.frequent_keys(docs, text_col)
        kind = "struct<text:string,n_lines:bigint,n_dropped:bigint,sha:string>"

        def rewritten(text: str | None, drop) -> tuple[str, int, int, str]:
            lines = (text or "").split("\n")
            kept = [x for x in lines if key_of(x, min_chars) not in drop] if drop else lines
            out = "\n".join(kept)
            return out, len(lines), len(lines) - len(kept), hashlib.sha256(out.encode("utf-8", "surrogatepass")).hexdigest()

        if certain.count() * 64 <= BROADCAST_BYTES:
            known = self.spark.sparkContext.broadcast(frozenset(bytes(r.key) for r in certain.toLocalIterator()))

            @F.pandas_udf(kind)
            def rewrite(texts: pd.Series) -> pd.DataFrame:
                return pd.DataFrame([rewritten(t, known.value) for t in texts], columns=["text", "n_lines", "n_dropped", "sha"])

            out = docs.withColumn(made, rewrite(F.col(text_col)))
        else:

            @F.pandas_udf(kind)
            def rewrite_by(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
                return pd.DataFrame([rewritten(t, () if k is None else {bytes(x) for x in k}) for t, k in zip(texts, keys, strict=True)], columns=["text", "n_lines", "n_dropped", "sha"])

            salt = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
            lines = self.flagged_by_shard(self.line_keys(docs, text_col)).withColumn("salt", F.pmod(F.xxhash64("text_key"), F.lit(SALTS)).cast("int"))
            sure = lines.join(certain.withColumn("salt", salt), ["key", "salt"], "left_semi").groupBy(F.col("text_key").alias(text_key)).agg(F.collect_list("key").alias(found))
            marked = docs.withColumn(text_key, F.md5(F.coalesce(F.col(text_col), F.lit(""))))
            out = marked.join(sure, text_key, "left").withColumn(made, rewrite_by(F.col(text_col), F.col(found)))
        keep = [c for c in docs.columns if c != text_col and c not in ("n_lines", "n_dropped", "kept_sha256")]
        return out.select(*[F.col(f"`{c}`") for c in keep], F.col(f"{made}.text").alias(text_col), F.col(f"{made}.n_lines").alias("n_lines"), F.col(f"{made}.n_dropped").alias("n_dropped"), F.col(f"{made}.sha").alias("kept_sha256"))


ORACLE = r"""
with l as (select rowid as r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as p from (select row_number() over () as rowid, * from documents)),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct r) >= 10),
m as (select k.*, f.key is not null as dropped from k left join f using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (dropped)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by p) filter (not dropped), '')) as kept_sha256
from m group by r, doc_id
"""
