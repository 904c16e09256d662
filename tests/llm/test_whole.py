"""Whole methods against brute force, large paths against small ones, and the pipeline's stages on awkward rows."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import DATA
from tidemark.llm import decontaminate, langid, licenses, line_dedup, mixing, near_dup, quality, token_shards, toxicity, urls
from tidemark.llm.common import materialise, running, tokens


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_best_language_path_is_exhaustively_best():
    rng = np.random.default_rng(3)
    for trial in range(400):
        n, k, penalty = int(rng.integers(1, 7)), int(rng.integers(1, 5)), float(rng.choice([0.5, 2.0, 6.0]))
        e = rng.normal(0, 3, (n, k))
        value = lambda p: sum(e[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
        assert math.isclose(value(langid.viterbi(e, penalty)), max(map(value, itertools.product(range(k), repeat=n))), abs_tol=1e-9), (trial, e)
    # Twenty words: b, then c, beat a throughout by almost two penalties at the cost of one.
    e = np.zeros((20, 3))
    e[:10, 1], e[10:, 2], e[:10, 2], e[10:, 1] = 1.1, 1.1, -1.1, -1.1
    assert langid.viterbi(e, 12.0).tolist() == [1] * 10 + [2] * 10


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, f"the cat sat on the mat number{i}", "en") for i in range(40)] + [(100 + i, "\u043a\u043e\u0442 \u0441\u0438\u0434\u0435\u043b \u043d\u0430 \u043a\u043e\u0432\u0440\u0435", "ru") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    mixed = spark.createDataFrame([(1, "the cat sat \u043a\u043e\u0442 \u0441\u0438\u0434\u0435\u043b on the mat"), (2, "qqq zzz \u0436"), (3, "12 34"), (4, "\u05e9\u05dc\u05d5\u05dd the cat")], "doc_id bigint, text string")
    got = {r.doc_id: ([(s.lang, s.start, s.end) for s in r.lang_spans], r.lang_pred) for r in langid.label_spans(mixed, langid.learn(d)).collect()}
    assert got[1] == ([("en", 0, 3), ("ru", 3, 5), ("en", 5, 8)], "en") and got[2][0][-1] == ("ru", 2, 3) and got[3] == ([], "und") and got[4][1] == "en"


def test_decoder_finds_the_best_of_all_readings(spark):
    text = "the idiot and the stupid moron are pathetic scum in a little assembly of fools " * 3
    model = toxicity.CharModel(toxicity.count_trigrams(spark.createDataFrame([(text,)], "text string")))

    def cost(word, channel):
        chars = ["^", "^", *word, "$"]
        return sum(model.log(*chars[i : i + 3]) for i in range(len(chars) - 2)) - channel

    for token in ("id10t", "m0r0n", "st*p1d", "p@th3t!c", "$cuum", "l1ttll3", "a$$emb|y", "f0()l5"):
        every = [("".join(c for c, _ in way), sum(x for _, x in way)) for way in itertools.product(*toxicity.readings(token))]
        best = max(cost(w, x) for w, x in every)
        got = toxicity.viterbi(model, token)
        assert math.isclose(max(cost(w, x) for w, x in every if w == got), best, abs_tol=1e-9), token


def test_character_counts_cover_all_texts(spark, docs):
    tables = toxicity.count_trigrams(docs)
    want = Counter()
    for r in docs.collect():
        word = ["".join(g) for c, g in itertools.groupby((r.text or "").lower(), str.isalpha) if c]
        for w in word:
            chars = ["^", "^", *w, "$"]
            want.update("".join(chars[i : i + 3]) for i in range(len(w) + 1))
    name = lambda k: "".join(chr(x) if x else "^" for x in (k >> 42, k >> 21 & 0x1FFFFF)) + (chr(k & 0x1FFFFF) if k & 0x1FFFFF else "$")
    assert {name(k): n for k, n in zip(*map(np.ndarray.tolist, tables["three"]))} == want
    assert tables["two"][1].sum() == tables["pairs"][1].sum() == tables["one"][1].sum() == sum(want.values())
    low = toxicity.entries(spark.createDataFrame([(1, 5), (2, 1), (3, 2)], "key bigint, n bigint"), most=2)
    assert low[0].tolist() == [1, 3]


def test_hits_match_a_plain_search(spark, docs):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    index = next(iter(decontaminate.index_shards(items)))
    d = docs.limit(80)
    want = {}
    term_of = {k: i for i, k in enumerate(index.keys.tolist())}
    v, step = len(index.words) + 1, index.stride
    for r in d.collect():
        ws = tokens(r.text or "")
        for w in range((len(ws) - 1) // step + 1):
            passage = ws[w * step : (w + 2) * step + 1]
            own = {term_of.get(index.words.get(a, 0) * v + index.words.get(b, 0)) for a, b in zip(passage, passage[1:])} - {None}
            scores = Counter()
            for t in own:
                for item, x in zip(*index.lists[t][:2]):
                    scores[item] += x
            for item, x in scores.items():
                if x >= index.threshold - 1e-12 and all(o >= index.overlap for o in decontaminate.verify(index, item, passage[: 2 * step])):
                    want.setdefault((r.doc_id, index.items[item][0]), []).append(round(x, 9))
    got = {(r.doc_id, h.item_id): round(h.score, 9) for r in decontaminate.find_hits(d, items).collect() for h in r.hits}
    assert got == {k: max(x) for k, x in want.items()} and got


def test_many_shards_find_what_one_finds(spark, docs):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    hits = lambda **o: {(r.doc_id, h.item_id, round(h.score, 9)) for r in decontaminate.find_hits(docs, items, out="text_hits", **o).collect() for h in r.text_hits}
    assert sum(1 for _ in decontaminate.index_shards(items, shard_postings=300)) > 2
    # The stride follows the longest item of a shard, so passages, and with them scores, may be cut elsewhere.
    assert {h[:2] for h in hits(shard_postings=300)} == {h[:2] for h in hits()} != set()


def test_classes_are_the_components_of_exact_links(spark, docs):
    d = docs.unionByName(docs.limit(20)).withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id")))
    bags = {}
    for r in docs.collect():
        ws = tokens(r.text or "")
        bags[r.doc_id] = Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else Counter()
    parent = {x: x for x in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(sorted(bags), 2):
        both = sum((bags[x] & bags[y]).values())
        if both and both >= 0.8 * (sum(bags[x].values()) + sum(bags[y].values()) - both):
            parent[max(root(x), root(y))] = min(root(x), root(y))
    members, _ = near_dup.near_duplicate_classes(d)
    assert {(r.doc_id, r.class_id) for r in members.collect()} == {(x, root(x)) for x in bags}
    kept = near_dup.dedup(d)
    assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect()) == Counter({root(x) for x in bags})


def test_robust_distances_reach_the_least_determinant(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, (4, 4)) + 2 * np.eye(4)
    good = rng.normal(0, 1, (600, 4)) @ a.T + 3
    bad = rng.normal(0, 0.2, (120, 4)) + np.array([30, -25, 20, 28])
    x = np.vstack([good, bad])
    rows = spark.createDataFrame([(i, "g", *map(float, v)) for i, v in enumerate(x)], "row_id bigint, group string, v0 double, v1 double, v2 double, v3 double")
    got = np.array([r.d for r in quality.robust_distances(rows).orderBy("row_id").collect()])
    best, h = None, int(0.75 * len(x))
    for _ in range(60):
        own = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(15):
            m, c = own.mean(0), np.cov(own.T, bias=True) + np.diag(quality.RIDGE) ** 2
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            own = x[np.argsort(d)[:h]]
        if best is None or np.linalg.det(c) < best[0]:
            best = np.linalg.det(c), d
    want = best[1] / max(1.0, np.median(best[1]) / quality.MEDIAN_CHI2_4)
    assert np.corrcoef(got[:600], want[:600])[0, 1] > 0.99 and abs(np.median(got / want) - 1) < 0.05
    cut = quality.cutoff_of()
    assert (got[600:] > cut).all() and (got[:600] < cut).all()
    assert abs(quality.cutoff_of(0.5) - quality.MEDIAN_CHI2_4) < 1e-3 and abs(quality.cutoff_of(0.001) - 18.467) < 1e-2


def test_quality_counts_match_loops(docs):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in docs.collect():
        text = r.text or ""
        lines = [x for x in text.split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
        x = got[r.doc_id]
        assert (x.n_symbols, x.n_dup_lines) == (sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) and not (x.base_failed and x.kept)


def test_estimates_joined_by_parts_are_the_same(spark, docs, monkeypatch):
    some = quality.judge(docs).select("doc_id", "kept", "distance")
    want = sorted(map(tuple, some.collect()))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, quality.judge(docs).select("doc_id", "kept", "distance").collect())) == want


def test_notices_are_found_wherever_a_whole_scan_finds_them():
    rng = random.Random(7)
    alphabet = "abcdefghijklmnopqrstuvwxyz "

    def spoiled(s, k):
        for _ in range(k):
            at = rng.randrange(len(s))
            s = rng.choice([s[:at] + s[at + 1 :], s[:at] + rng.choice(alphabet) + s[at:], s[:at] + rng.choice(alphabet) + s[at + 1 :]])
        return s

    for notice in licenses.NOTICES:
        one = licenses.Scanner((notice,))
        for _ in range(25):
            text = " ".join("".join(rng.choice(alphabet[:-1]) for _ in range(rng.randrange(1, 9))) for _ in range(30))
            parts = [text, *(spoiled(notice[0], rng.randrange(0, notice[2] + 3)) for _ in range(2)), text[::-1]]
            line = f" {' '.join(' '.join(parts).split())} "
            best = one.patterns[0].search(line)
            found = one.matches(line)
            assert bool(found) == bool(best)
            if best:
                assert min(m[3] for m in found) == sum(best.fuzzy_counts) and all(b[1] >= a[2] for a, b in zip(found, found[1:]))


def test_running_sums_in_blocks(spark):
    rows = [(k, i, (7 * i + ord(k)) % 5) for k in ("a", "b") for i in range(0, 300, 3)]
    got = {(r.k, r.at): r.before for r in running(spark.createDataFrame(rows, "k string, at bigint, v bigint"), ["k"], "at", "v", "before", fan=7).collect()}
    assert got == {(k, i): sum(v for q, j, v in rows if q == k and j < i) for k, i, _ in rows}


def test_copies_of_the_mix_are_what_it_takes(docs):
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_sizes(docs).collect() if r.size}
    copies = Counter(r.doc_id for r in mixing.mix(docs).select("doc_id").collect())
    assert {x: copies[x] for x in taken} == taken and max(taken.values()) <= 3


def test_lines_by_shuffle_and_layers_give_the_same(spark, docs, monkeypatch):
    rows = lambda x: sorted((r.doc_id, r.n_dropped, r.kept_sha256) for r in x.apply(docs).collect())
    x = line_dedup.LineIndex.empty(spark, min_docs=3).insert(docs)
    want = rows(x)
    assert sum(r[1] for r in want)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert rows(x) == want
    monkeypatch.setattr(line_dedup, "COMPACT", 2)
    y = x
    for k in range(3):
        y = y.delete(docs.where(F.col("doc_id") % 5 == k))
    left = line_dedup.LineIndex.empty(spark, min_docs=3).insert(docs.where(F.col("doc_id") % 5 > 2))
    assert y.base > 1 and sorted(map(tuple, y.counts.collect())) == sorted(map(tuple, left.counts.collect())) and y.frequent == left.frequent
    for k in range(3):
        y = y.insert(docs.where(F.col("doc_id") % 5 == k))
    assert rows(y) == want


def test_full_filters_are_made_anew(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KICKS", 1)
    d = lambda a, b: spark.range(a, b).selectExpr("id as doc_id", "concat('line ', id) as text")
    x = line_dedup.LineIndex.empty(spark, min_docs=1).insert(d(0, 20)).insert(d(20, 400))
    assert {r.n_dropped for r in x.apply(d(0, 400)).collect()} == {1}


def test_slots_do_not_depend_on_the_split(spark, docs):
    folders = [token_shards.new_folder(spark, "split") for _ in range(2)]
    d = docs.unionByName(docs.limit(5)).withColumn("slot", F.lit("clash"))
    made = [sorted(map(tuple, token_shards.write_shards(x, f, length=128, per_shard=300).drop("path").collect())) for x, f in zip((d, d.repartition(7)), folders)]
    assert made[0] == made[1] and len({r[1] for r in made[0]}) > 2
    assert Counter(r[1] for r in made[0]).most_common()[-2][1] == 300
    a, b = (list(token_shards.read_slots(f, 290, 20)) for f in folders)
    assert [s for s, _ in a] == list(range(290, 310)) and all((x == y).all() for (_, x), (_, y) in zip(a, b))


def test_urls_of_awkward_pages(spark):
    p = spark.createDataFrame([(1, "http://a.net/x", None, 5), (1, "http://a.net/x", None, 5), (2, None, "<a href=http://a.net>", 5), (3, "http://b.com/", "", 5)], "page_id int, url string, html string, host int")
    assert sorted((r.page_id, r.verdict) for r in urls.judge(p).collect()) == [(1, "block"), (1, "block"), (2, "allow"), (3, "allow")]
    assert urls.judge(p.limit(0)).count() == 0


def test_pipeline_end_to_end(spark):
    at, seen = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, materialise(stage(spark, at, DATA), f"test-{name}")
        seen[name] = at
        if name != "token_shards":
            assert at.columns == before.columns
    ids = lambda name: Counter(r.doc_id for r in seen[name].select("doc_id").collect())
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    evidence = toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert ids("toxicity") == Counter(r.doc_id for r in toxicity.score(docs, evidence).where("score < 0.3").collect())
    members, _ = near_dup.near_duplicate_classes(seen["toxicity"])
    assert ids("near_duplicates") == Counter({r.class_id for r in members.collect()})
    hits = decontaminate.find_hits(seen["near_duplicates"], spark.read.parquet(f"{DATA}/benchmark.parquet")).where("size(hits) > 0")
    assert ids("near_duplicates") - ids("decontamination") == Counter(r.doc_id for r in hits.collect())
    assert set(ids("mixing")) <= set(ids("decontamination")) and max(ids("mixing").values()) <= 3
    used = {i for r in seen["token_shards"].collect() for i in r.doc_ids}
    assert used == set(ids("mixing")) and seen["token_shards"].count() == corpus_pipeline.run(spark, DATA).count()


def test_every_stage_on_awkward_rows(spark, docs):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, None, None, None), (3, "", "en", None), (None, "short text", None, "b"), (5, "x " * 30_000, "en", "b")]
    odd = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], docs.select("doc_id", "text", "lang", "source", "n_chars").schema).withColumns({"slot": F.lit(1), "score": F.lit("s"), "hits": F.lit(0)})
    for name, stage in corpus_pipeline.STAGES:
        for d in (odd, odd.limit(0)):
            out = stage(spark, d, DATA)
            assert (out.count() > 0) == (d.count() > 0)
            if name != "token_shards":
                assert out.columns == d.columns
