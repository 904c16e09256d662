"""Merkle manifest of a dataset: a leaf per row, a tree per group, a tree over the groups' roots, and a proof for every row.

1. Leaves are sorted by range; a task numbers its rows, and counts per group and task give each leaf its rank in the group.
2. Ranks are taken as binary digits. Within a block of 2**BLOCK_BITS ranks, one digit after the other is grouped away: two children become
   an array in their parent's struct. All these groupings keep to the block, so a block moves once and never grows.
3. Blocks' roots are the leaves of the next round, a thousandth as many each time; no task holds more than one block at once.
4. From the top, a block's nested struct is opened by transforms, each child with its path of siblings, and exploded into leaves: no leaf
   is joined. Only whole blocks meet the path that their root has in the round above.

Defined results: nulls are written as `-`; null groups come first and are a group; null order values come first; equal order values
go by their leaf; repeated rows are leaves each; texts are hashed whole; no rows give no leaves; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.spelling import CRC, CRC_TABLE

BLOCK_BITS, TAMPER_EVERY = 10, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<sibling:string,left:boolean>>"


def leaf_hash(*values: Column) -> Column:
    """sha256 of all values, each as its UTF-8 byte count, a colon and its text, nulls as a dash."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path (siblings from the leaf upwards; null where a node has none) give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.when(p.sibling.isNull(), h).when(p.left, F.concat(p.sibling, h)).otherwise(F.concat(h, p.sibling)), 256))


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves with pos (rank within key by `order`, from 0) and size (rows of the key). No window holds more than a row per task and key."""
    d = leaves.withColumn("tie", F.monotonically_increasing_id())  # only equal leaves are told apart by it
    d = d.repartitionByRange("key", *order, "tie").sortWithinPartitions("key", *order, "tie").drop("tie")
    # Consecutive in a partition, the partition's number above.
    d = materialise(d.withColumn("line", F.monotonically_increasing_id()), "merkle-leaves").withColumn("part", F.shiftright("line", 33))
    w = Window.partitionBy("key")
    before = F.coalesce(F.sum("rows").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = d.groupBy("key", "part").agg(F.min("line").alias("first"), F.count("*").alias("rows"))
    stretches = stretches.select("key", "part", (F.col("first") - before).alias("shift"), F.sum("rows").over(w).alias("size"))
    return d.join(stretches, ["key", "part"]).withColumn("pos", F.col("line") - F.col("shift")).drop("line", "part", "shift")


def blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """key, size, block, tree (h and, nested `bits` deep, kids down to the nodes) of nodes (key, size, pos, node: a struct with h)."""
    d = nodes.withColumn("block", F.shiftright("pos", bits)).repartition("key", "block")
    for level in range(bits):
        digit = F.shiftright("pos", level).bitwiseAND(1)
        d = d.groupBy("key", "size", "block", F.shiftleft(F.shiftright("pos", level + 1), level + 1).alias("pos")).agg(F.sort_array(F.collect_list(F.struct(digit.alias("digit"), "node"))).alias("kids"))
        kids = F.transform("kids", lambda k: k.node)
        # Once one node is left, it stands unchanged.
        h = F.when(F.col("size") > (1 << level), F.sha2(F.array_join(F.transform(kids, lambda k: k.h), ""), 256)).otherwise(F.element_at(kids, 1).h)
        d = d.select("key", "size", "block", "pos", F.struct(h.alias("h"), kids.alias("kids")).alias("node"))
    return d.select("key", "size", "block", F.col("node").alias("tree"))


def build(nodes: DataFrame, bits: int = BLOCK_BITS) -> list[DataFrame]:
    """Rounds of blocks, each over the roots of those before, until each key has one block."""
    span, rounds = 1 << bits, []
    while True:
        rounds.append(materialise(blocks(nodes, bits), "merkle-blocks"))
        above = rounds[-1].where(F.col("size") > span)
        if above.isEmpty():
            return rounds
        nodes = above.select("key", F.ceil(F.col("size") / span).alias("size"), F.col("block").alias("pos"), F.struct(F.col("tree.h").alias("h")).alias("node"))


def roots(rounds: list[DataFrame], bits: int = BLOCK_BITS) -> DataFrame:
    """key, root of each key's tree."""
    out = None
    for trees in rounds:
        tops = trees.where(F.col("size") <= 1 << bits).select("key", F.col("tree.h").alias("root"))
        out = tops if out is None else out.unionByName(tops)
    return out


def _opened(level: int):
    """A node with its path becomes its children with theirs."""

    def spread(s: Column) -> Column:
        def child(kid: Column, i: Column) -> Column:
            sibling = F.when(F.size(s.node.kids) == 2, F.element_at(s.node.kids, 2 - i).h)
            step = F.array(F.struct(sibling.alias("sibling"), (i == 1).alias("left")))
            return F.struct(kid.alias("node"), F.when(F.col("size") > (1 << level), F.concat(step, s.path)).otherwise(s.path).alias("path"))

        return F.transform(s.node.kids, child)

    return spread


def unfold(trees: DataFrame, bits: int) -> DataFrame:
    """A row per leaf of trees (key, size, block, tree, path and others): its pos, node and path from there up; other columns as they are."""
    state = F.array(F.struct(F.col("tree").alias("node"), F.col("path").alias("path")))
    for level in reversed(range(bits)):
        state = F.flatten(F.transform(state, _opened(level)))
    rest = [c for c in trees.columns if c not in ("tree", "path", "block")]
    out = trees.select(*rest, "block", F.posexplode(state).alias("i", "leaf"))
    return out.select(*rest, (F.shiftleft("block", bits) + F.col("i")).alias("pos"), "leaf.node", "leaf.path")


def prove(rounds: list[DataFrame], above: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """A row per leaf with node, path (from the leaf to the root above), subroot (of its key) and what else `above` has: key, path and others per key."""
    given, leaves = [c for c in above.columns if c not in ("key", "path")], None
    for trees in reversed(rounds):
        d = trees.where(F.col("size") <= 1 << bits).join(above, "key").withColumn("subroot", F.col("tree.h"))
        if leaves is not None:
            higher = leaves.select("key", F.col("pos").alias("block"), "path", "subroot", *given)
            d = d.unionByName(trees.where(F.col("size") > 1 << bits).join(higher, ["key", "block"]))
        leaves = unfold(d, bits)
    return leaves


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """`order`, leaf, subroot, root, path and the columns `carry` (made from docs) for every row of docs."""
    carry = carry or {}
    # Null comes first, then the groups as bytes.
    key = F.coalesce(F.concat(F.lit("~"), F.col(group).cast("string")), F.lit(""))
    d = docs.select(key.alias("key"), F.col(order).alias("order_value"), leaf_hash(*[F.col(c) for c in fields]).alias("h"), F.struct(F.lit(None).alias("none"), *[c.alias(n) for n, c in carry.items()]).alias("carried"))
    # Equal leaves of a group may differ in what they carry, never in their proof.
    nodes = ranked(d, ["order_value", "h"]).select("key", "size", "pos", F.struct("h", "order_value", "carried").alias("node"))
    rounds = build(nodes, bits)
    groups = roots(rounds, bits).select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("root").alias("h"))
    tops = build(ranked(groups, ["group"]).select("key", "size", "pos", F.struct("h", "group").alias("node")), bits)
    nothing = d.sparkSession.range(1).select(F.lit("").alias("key"), F.array().cast(PATH).alias("path"))
    above = prove(tops, nothing, bits).select(F.col("node.group").alias("key"), "path", F.col("subroot").alias("root"))
    out = prove(rounds, above, bits)
    return out.select(F.col("node.order_value").alias(order), F.col("node.h").alias("leaf"), "subroot", "root", "path", *[F.col("node.carried")[n].alias(n) for n in carry])


def audited(docs: DataFrame, every: int = TAMPER_EVERY, bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row is checked by its proof, after one field of some was changed."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    changed = leaf_hash(*[F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    d = manifest(docs, carry={"shown": F.when(tampered, changed)}, bits=bits)
    siblings = F.array_join(F.transform(F.filter("path", lambda p: p.sibling.isNotNull()), lambda p: p.sibling), "")
    d = d.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("shown", "leaf"), F.col("path")).alias("folded_root"))
    return d.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


def _climb(name: str, start: str) -> str:
    """SQL for all levels of a tree: name(level, key, pos, h, size) from `start`."""
    up = f"select any_value(level) + 1, key, pos // 2, sha256(string_agg(h, '' order by pos)), any_value((size + 1) // 2) from {name} where size > 1 group by key, pos // 2"
    return f"{name}(level, key, pos, h, size) as ({start} union all {up})"


def oracle() -> str:
    """DuckDB SQL for audited() with the default parameters."""
    return f"""with recursive {CRC_TABLE},
leaf as materialized (select row_number() over (order by doc_id) as row_no, doc_id, coalesce('~' || lang, '') as key, {_leaf("n_chars")} as h,
  case when {CRC.format("doc_id::varchar")} % {TAMPER_EVERY} = 0 then {_leaf("(n_chars::hugeint + 1)")} end as shown from documents, crc),
placed as materialized (select *, row_number() over (partition by key order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by key) as size from leaf),
{_climb("low", "select 0, key, pos, h, size from placed")}, lows as materialized (select * from low),
sub as materialized (select key as lang_key, h, row_number() over (order by key) - 1 as pos, count(*) over () as size from lows where size = 1),
{_climb("high", "select 0, 'all', pos, h, size from sub")}, highs as materialized (select * from high),
steps as (select p.row_no, n.level, o.h as sibling, (p.pos >> n.level) % 2 = 1 as is_left from placed p join (select distinct level, key from lows where size > 1) n on n.key = p.key left join lows o on o.key = p.key and o.level = n.level and o.pos = xor(p.pos >> n.level, 1)
  union all select p.row_no, 1000 + n.level, o.h, (s.pos >> n.level) % 2 = 1 from placed p join sub s on s.lang_key = p.key cross join (select distinct level from highs where size > 1) n left join highs o on o.level = n.level and o.pos = xor(s.pos >> n.level, 1)),
paths as (select row_no, list({{'sibling': sibling, 'is_left': is_left}} order by level) as path from steps group by row_no),
folded as (select p.*, coalesce(t.path, []) as path, list_reduce(list_prepend({{'sibling': coalesce(p.shown, p.h), 'is_left': false}}, coalesce(t.path, [])), lambda a, s: {{'sibling': sha256(case when s.sibling is null then a.sibling when s.is_left then s.sibling || a.sibling else a.sibling || s.sibling end), 'is_left': false}}).sibling as folded_root from placed p left join paths t using (row_no))
select doc_id, f.h as leaf, s.h as subroot, r.h as root, sha256(array_to_string(list_transform(path, lambda s: coalesce(s.sibling, '')), '')) as proof_sha256, folded_root, folded_root = r.h as verified
from folded f join sub s on s.lang_key = f.key cross join (select h from highs where size = 1) r"""
