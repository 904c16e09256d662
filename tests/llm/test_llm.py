"""Operators against brute force, exact round trips and defined results on awkward rows."""

from collections import Counter

import numpy as np
import pytest

from tests.oracle import DATA, same
from tidemark.llm import decontaminate, langid, licenses, line_dedup, mixing, near_dup, quality, queries, token_shards, toxicity, urls
from tidemark.llm.common import tokens

WORDS = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, WORDS, "en", "a"), (1, WORDS, "en", "a"), (2, None, None, None), (3, "", "en", None), (None, "short text", None, "b"), (4, WORDS + " extra", "de", "a"), (5, "x " * 20_000, "en", "b"), (6, " \n\t\n", "fr", "c")]
    # Extra columns with names that the operators use inside.
    return spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id bigint, text string, lang string, source string, hits int, row_key string")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6 word7. word8 word9 word10"), (2, None), (None, "word20 word21 word22 word23"), (3, "")], "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (4, 1, 0), (None, 1, 1), (1, 1, 0)], "doc_id bigint, toxic int, quality int")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_odd_and_empty_rows(spark, odd, bench, labels):
    for d in (odd, odd.limit(0)):
        n = d.count()
        assert decontaminate.find_hits(d, bench, out="found").count() == n
        assert {r.doc_id for r in decontaminate.decontaminate(d, bench).collect()} <= {2, 3, None, 5, 6}
        assert mixing.mix_sizes(d).count() == n
        assert mixing.mix(d).columns == d.columns
        members, _ = near_dup.near_duplicate_classes(d)
        assert members.count() == n
        kept = near_dup.dedup(d)
        assert kept.columns == d.columns and kept.count() == (6 if n else 0)
        assert toxicity.score(d, toxicity.learn(d, labels)).count() == n
        assert quality.judge(d).count() == n
        assert langid.label_spans(d, langid.learn(d)).count() == n
        assert line_dedup.LineIndex.empty(spark).insert(d).apply(d).count() == n
        assert licenses.scan(d).count() == n
        token_shards.write_shards(d, length=64, per_shard=16).collect()


def test_block_max_wand_finds_all_above_the_threshold():
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"t{x}" for x in rng.integers(0, 40, rng.integers(3, 30)))) for i in range(60)]
    df = Counter(t for _, text in rows for t in set(zip(tokens(text), tokens(text)[1:])))
    index = decontaminate.build_index(rows, 60, 15.0, df, threshold=0.2)
    for _ in range(200):
        terms = sorted(set(rng.integers(0, index.size, 30).tolist()))
        want = Counter()
        for t in terms:
            for item, x in zip(*index.lists[t][:2]):
                want[item] += x
        assert {i: round(s, 9) for i, s in decontaminate.block_max_wand(index, terms)} == {i: round(s, 9) for i, s in want.items() if s >= 0.2 - 1e-12}


def test_planted_passages_are_found(spark):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {(r.doc_id, h.item_id) for r in decontaminate.find_hits(docs, items).collect() for h in r.hits}
    texts = {r.item_id: r.text for r in items.collect()}
    assert {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in r.text} <= got


def test_bag_min_hash_estimates_weighted_jaccard():
    rng, errors = np.random.default_rng(2), []
    for _ in range(20):
        h = rng.integers(1, 2**63, 300).astype(np.uint64)
        a, b = rng.integers(0, 6, 300), rng.integers(0, 6, 300)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        s = near_dup.bag_min_hash([(h[a > 0], a[a > 0]), (h[b > 0], b[b > 0])], 512)
        errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.015


def test_near_duplicate_classes_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    members, _ = near_dup.near_duplicate_classes(docs)
    got = {r.doc_id: r.class_id for r in members.collect()}
    word_hash, bags = near_dup.WordHash(), {}
    for r in docs.collect():
        bags[r.doc_id] = set(near_dup.elements(*near_dup.bag(r.text, word_hash)).tolist())
    for x in bags:
        for y in bags:
            if x < y and bags[x] and len(bags[x] & bags[y]) >= 0.8 * len(bags[x] | bags[y]):
                assert got[x] == got[y]


def test_links_in_large_buckets_are_found_past_a_lone_central_node(spark, monkeypatch):
    # One bucket holds class a (20 nodes), a lone central node b, and the classes c and d, linked by c6 and d0 alone.
    chain = lambda name, n, start: [(f"{name}{i}", list(range(start + 10 * i, start + 10 * i + 100))) for i in range(n)]
    a, c, d = chain("a", 20, 100_000), chain("c", 7, 0), chain("d", 7, 70)
    lone = [("b", list(range(200_000, 200_100)))]
    other = [(f"x{i}", list(range(300_000 + 1000 * i, 300_100 + 1000 * i))) for i in range(40)]
    buckets = [(1, a + lone + c + d), (2, c), (3, d), (4, a), (5, lone + other)]
    rows = [(i, name, name.encode(), [k for k, members in buckets if (name, e) in members], e) for i, (name, e) in enumerate(a + lone + c + d + other)]
    signed = spark.createDataFrame(rows, "doc_id bigint, row_key string, node binary, bands array<bigint>, elements array<int>")
    monkeypatch.setattr(near_dup, "signatures", lambda *_: signed)
    got = {r.row_key: r.class_id for r in near_dup.near_duplicate_classes(None)[0].collect()}
    assert len({got[name] for name, _ in c + d}) == 1 and len({got[name] for name, _ in a}) == 1
    assert len(set(got.values())) == 2 + 1 + 40


def test_decoder_restores_disguised_words(spark):
    model = toxicity.CharModel(toxicity.count_trigrams(spark.createDataFrame([("the idiot and the stupid moron are pathetic scum " * 5,)], "text string")))
    for disguised, word in (("id10t", "idiot"), ("st*pid", "stupid"), ("stuuupid", "stupid"), ("m0r0n", "moron"), ("$cum", "scum"), ("p@thetic", "pathetic"), ("stupid$$$", "stupid")):
        assert word in toxicity.restore(model, disguised), disguised
    assert ("idiot",) in toxicity.Reader(model).spelled("you i d i o t there".split())


def test_decoder_reads_signs_alone_doubled_letters_and_long_runs(spark):
    model = toxicity.CharModel(toxicity.count_trigrams(spark.createDataFrame([("you are an ass and the idiot and the stupid little moron " * 5,)], "text string")))
    for disguised, word in (("@$$", "ass"), ("4$$", "ass"), ("(4$$)!", "ass"), ("@$$!", "ass"), ("stuupid", "stupid"), ("iddiot", "idiot"), ("little", "little")):
        assert word in toxicity.restore(model, disguised), disguised
    assert toxicity.restore(model, "2024") == () and toxicity.restore(model, "$$$") == ()
    spelled = toxicity.Reader(model).spelled(list("theandthe" * 5 + "idiot" + "theandthe" * 5))
    assert ("idiot",) in spelled and spelled <= {("the",), ("and",), ("idiot",)}


def test_cuckoo_filter_and_reversible_counts(spark):
    keys = [line_dedup.key_of(f"line {i}") for i in range(5000)]
    f = line_dedup.CuckooFilter.of(keys)
    assert all(k in f for k in keys)
    assert sum(line_dedup.key_of(f"other {i}") in f for i in range(5000)) < 10
    for k in keys[:2500]:
        assert f.delete(k)
    assert all(k in f for k in keys[2500:])
    d = spark.createDataFrame([(i, f"same\nown {i}") for i in range(12)], "doc_id int, text string")
    x = line_dedup.LineIndex.empty(spark).insert(d)
    assert {r.n_dropped for r in x.apply(d).collect()} == {1}
    y = x.delete(d.where("doc_id < 3"))
    assert {r.n_dropped for r in y.apply(d).collect()} == {0} and {r.n_dropped for r in x.apply(d).collect()} == {1}
    assert {r.n_dropped for r in y.insert(d.where("doc_id < 3")).apply(d).collect()} == {1}


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(token_shards.feistel(np.arange(n), n).tolist()) == list(range(n))


def test_token_shards_round_trip_and_resume(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    folder = token_shards.new_folder(spark, "test")
    manifest = {r.slot: r for r in token_shards.write_shards(docs, folder, length=128, per_shard=64).collect()}
    read = list(token_shards.read_slots(folder))
    assert [s for s, _ in read] == list(range(len(manifest)))
    assert [s for s, _ in token_shards.read_slots(folder, 10, 5)] == list(range(10, 15))
    encode = token_shards.Encoder(token_shards.Vocabulary.load())
    want = Counter(t for r in docs.collect() for t in np.frombuffer(encode(r.text), "<u2").tolist())
    got = Counter(t for _, x in read for t in x.tolist())
    assert got.pop(50256) == docs.count() and got == want
    # Whole files but the last, and the sequence that a slot holds is the one that the permutation says.
    slots = token_shards.feistel(np.arange(len(read)), len(read), token_shards.KEY).tolist()
    stream = [t for s in slots for t in read[s][1].tolist()]
    texts = {tuple(np.frombuffer(encode(r.text), "<u2").tolist()) for r in docs.collect()}
    ends = [i for i, t in enumerate(stream) if t == 50256]
    assert {tuple(stream[a + 1 : b]) for a, b in zip([-1, *ends[:-1]], ends)} == texts
    assert all(len(x) == manifest[s].n_tokens for s, x in read)


def test_licenses_base_and_fuzzy():
    s = licenses.Scanner()
    x = s.scan("Code. All RIGHTS reserved! licensd under CC-BY-NC 4.0, and released under teh MIT license")
    assert (x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == (2, 1, 6, "cc-by,reserved")
    assert x["labels"] == "cc-by,cc-by-nc,mit,reserved"
    assert s.scan(None)["n_words"] == 0


def test_license_spans_of_neighbouring_notices():
    s = licenses.Scanner()
    spans = lambda text: [(x["label"], x["start"], x["end"], x["errors"]) for x in s.scan(text)["spans"]]
    assert spans("released under teh mit license released under the mit license") == [("mit", 0, 5, 2), ("mit", 5, 10, 0)]
    assert len(spans("released under teh mit license " * 40 + "released under the mit license")) == 41
    assert [x[3] for x in spans("released under the mit licen released under teh mit license")] == [2, 2]


def test_url_hosts_and_paths(spark):
    p = spark.createDataFrame([(1, "http://A.Example.NET/en/x?q"), (2, None), (3, "nourl"), (4, "x://h.org/fr/#a"), (5, "http://b.net")], "page_id int, url string").selectExpr("*", "null as html")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(p.withColumn("html", p.html.cast("string"))).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("", "", None, "allow") and got[4] == ("h.org", "/fr/", "org/fr/", "allow")


def test_small_hosts_are_blocked_beside_millions_of_seed_pages(spark):
    big = spark.range(3_000_000).selectExpr("id as page_id", "'http://big.net/x' as url", "cast(null as string) as html")
    small = spark.createDataFrame([(-1, "http://bad.net/x", None), (-2, "http://friend.com/x", "<a href='http://bad.net/x'>")], "page_id bigint, url string, html string")
    got = {r.page_id: (r.verdict, r.distrust) for r in urls.judge(big.unionByName(small)).where("page_id < 0").collect()}
    assert got[-2] == ("block", 0.0)


def test_statistics_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in docs.collect():
        ws = [w for w in __import__("re").split("[\x20\x09-\x0d]+", r.text or "") if w]
        places = {}
        for i in range(len(ws) - 2):
            places.setdefault(tuple(ws[i : i + 3]), []).append(i)
        repeated = {j for at in places.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_repeat_words) == (len(ws), sum(map(len, ws)), len(repeated))


def test_small_groups_are_judged_by_all_rows_of_their_language(spark):
    text = lambda k: " ".join(f"w{k}{chr(97 + i % 26)}{i}" for i in range(60))
    junk = " ".join(f"#$%&|{i}" for i in range(60))
    rows = [(k, text(k), "en", "big") for k in range(150)] + [(1000 + k, junk, "en", "junk") for k in range(3)] + [(2000, text(2000), "en", "rare"), (3000, junk, "xx", "a"), (3001, text(3001), "yy", "a")]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert {i for i, k in kept.items() if not k} == {1000, 1001, 1002, 3000} and len(kept) == len(rows)


def test_long_words_are_scored_whole():
    assert langid.plain("(" + "Ab" * 5000 + "1c)") == "ab" * 5000 + "c"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = queries.op7_language(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
