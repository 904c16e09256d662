"""Spelling variants, Merkle manifests and archive packages against brute force, at small block sizes and on awkward rows."""

import hashlib
import io
import pickle
import random
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses, merkle, spelling, token_shards, toxicity, warc


# -- spelling ---------------------------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, factor):
    """word: (n, n_near, form, form_n, root)."""
    form, links = {}, {}
    for w in counts:
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        links[w] = len(close)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], links[w], form[w], counts.get(form[w]), root)
    return out


def test_variants_match_brute_force_over_many_stretches(spark, monkeypatch):
    rng = random.Random(5)
    counts = Counter()
    while len(counts) < 300:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(3, 7)))
        counts[w] = int(2 * 3 ** rng.randint(0, 4)) + rng.randint(0, 2)
    # Words that are each other's beginnings, over the border of stretches.
    counts |= {"a" * k: 2 + k for k in range(3, 40)}
    rows = [(i, " ".join(w for _ in range(n))) for i, (w, n) in enumerate(counts.items())]
    monkeypatch.setattr(spelling, "PART_WORDS", 40)
    got = spelling.group_variants(spark.createDataFrame(rows, "doc_id bigint, text string"), least_length=3, factor=3, every=0).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == variants(counts, 3)


def test_trie_nodes_are_numbered_like_their_prefixes():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(400)} | {"a" * 30, "a" * 12})
    cuts = [0, 3, 4, 5, 60, 61, len(words)]
    parts = [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    numbers = defaultdict(set)
    for part, *sides in spelling.borders([(i, p[0], p[-1]) for i, p in enumerate(parts)]):
        for w, path in zip(parts[part], spelling.walk(parts[part], (part + 1) << 32, [tuple(sides[:2]), tuple(sides[2:])]), strict=True):
            for i, x in enumerate(path):
                numbers[w[:i]].add(x)
    assert all(len(x) == 1 for x in numbers.values())
    assert len({x for xs in numbers.values() for x in xs}) == len(numbers)


def test_spelling_of_awkward_rows(spark):
    long = "q" * 3000
    rows = [(1, "Nothing nothing", 1), (1, "Nothing nothing", 1), (None, "nothing nOTHING×", 2), (2, None, 3), (3, "", 4), (4, f"{long} {long}", 5), (5, f"{long}q {long}q", 5)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, rank int")
    counts = Counter()
    for doc_id, text, _ in rows:
        for run in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in text or "").split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = variants({w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}, 10)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group_variants(d).collect()} == want
    assert spelling.group_variants(d.limit(0)).collect() == []


# -- Merkle manifest --------------------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root, and each node's siblings from below with True for a left one."""
    level, paths, at = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(level) > 1:
        for i, k in enumerate(at):
            other = k ^ 1
            paths[i].append((level[other] if other < len(level) else None, k % 2 == 1))
            at[i] = k // 2
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for g in langs:
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        built[g] = (ordered, *tree([leaf(*r) for r in ordered]))
    root, tops = tree([built[g][1] for g in langs])
    out = []
    for g, top in zip(langs, tops, strict=True):
        ordered, subroot, paths = built[g]
        for r, path in zip(ordered, paths, strict=True):
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                shown = (*r[:4], r[4] + 1)
            h = leaf(*shown)
            for sibling, left in path + top:
                h = sha(h if sibling is None else sibling + h if left else h + sibling)
            out.append((r[0], leaf(*r), subroot, root, sha("".join(s for s, _ in path + top if s)), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_matches_brute_force(spark, bits):
    rng = random.Random(3)
    rows = [(i, f"text {i}", rng.choice(["en"] * 8 + ["de", "é", "fr"]), "s", i % 9) for i in range(70)] + [(900, "", "only", None, 1), (901, "alone", None, "a", None), (902, None, None, "a", 2**63 - 1)]
    # Nulls, ties of doc_id, repeated rows.
    rows += [(None, None, None, None, None), (None, None, None, None, None), (5, "other", "en", "s", 1), (5, "other", "en", "s", 1), (None, "x", "en", "s", 3)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, pos int")
    assert sorted(map(tuple, merkle.audited(d, bits=bits).collect()), key=str) == manifest(rows)


def test_manifest_of_few_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for rows in ([], [(1, "a", "en", "s", 1)], [(2, "a", "en", "s", 1), (2, "a", "en", "s", 1)]):
        assert sorted(map(tuple, merkle.audited(spark.createDataFrame(rows, schema)).collect()), key=str) == (manifest(rows) if rows else [])


# -- archive packages -------------------------------------------------------------------------------------------------------------


PAGES = [(1, "http://a.org/x y", "same", 1), (7, "http://b.org/é", "same", 1), (9, None, "same", 1), (9, None, "same", 1), (None, "http://c.org", "same", 1), (2, "bad://[url", None, 1), (3, "line\r\nbreak", "", 1), (None, None, "only null", 1), (4, "http://d.org", "ü" * 200_000, 1), (5, "http://d.org/1", "HTTP/1.1 200\r\n\r\nWARC/1.1\r\n\r\n", 1)]


def archived(rows, min_bytes):
    out = []
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "").encode() == payload and r[0] is not None]
        again = len(payload) >= min_bytes and ids and (page_id is None or page_id < max(ids))
        out.append((page_id, len(payload), warc.base32_sha1(payload), "revisit" if again else "response", max(ids) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 3, 100])
def test_archives_give_back_what_was_written(spark, min_bytes):
    d = spark.createDataFrame(PAGES, "page_id bigint, url string, html string, salt int")
    assert sorted(map(tuple, warc.archived(d, min_bytes).collect()), key=str) == archived(PAGES, min_bytes)
    assert warc.archived(d.limit(0)).collect() == []


def test_packages_are_read_in_small_steps(spark):
    rows = [(i, f"http://h{i % 7}.org/{i}", f"page {i % 50} " * (i % 13), 1) for i in range(200)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string, x int").repartition(2)
    made = warc.write_packages(d, limit=3000)
    assert made.count() > 4 and made.agg(F.sum("records")).first()[0] == 200
    pieces = warc.index_pieces(made, piece=100)
    whole = warc.record_places(warc.index_pieces(made))
    places = warc.record_places(pieces, piece=100)
    assert sorted(map(tuple, places.collect())) == sorted(map(tuple, whole.collect())) and places.count() == 200
    read = {r.record_id: r for r in warc.read_records(places, payloads=True, chunk=500).collect()}
    want = {i: html for i, _, html, _ in rows}
    for i, url, html, _ in rows:
        r = read[f"urn:page:{i}"]
        assert r.url == url and r.payload_bytes == len(html)
        assert r.payload.decode() == html and r.intact if r.record_type == "response" else want[int(r.refers_to[9:])] == html


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("before", [b"", b"bytes before the archive"])
def test_directories(monkeypatch, wide, before):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 30)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    raw, want = io.BytesIO(), {f"archive/{i}-é.warc": bytes([65 + i]) * 50 * i for i in range(5)}
    with zipfile.ZipFile(raw, "w") as z:
        for name, data in want.items():
            z.writestr(name, data)
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 in it, and more bytes than an end record has"
    data = raw.getvalue()
    assert (b"PK\x06\x07" in data) == wide
    f = Bytes(before + data)
    for step in (7, 1 << 20):
        found = list(warc.members(f, step))
        assert {m.name: f.read_at(m.size, m.start(f)) for m in found if not m.method} == want
        assert [m.name for m in found if m.method] == ["packed"]


def test_packages_without_index_or_with_damage_are_errors(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.wacz", "w") as z:
        z.writestr("archive/data.warc", b"")
    (tmp_path / "b.wacz").write_bytes(b"not a package")
    for name, what in (("a", "no stored index"), ("b", "not a ZIP package")):
        with pytest.raises(Exception, match=what):
            warc.read_packages(spark.createDataFrame([(f"file://{tmp_path}/{name}.wacz",)], "path string")).collect()


# -- limits of earlier operators --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1, 3, 9, 40])
def test_tables_of_frequent_sequences_find_a_limit(spark, most):
    counts = {k: n for k, n in enumerate([1, 1, 2, 7, 999, 1000, 1001, 1999, 2000, 5000, 10**6, 10**6, 10**9, 3 * 10**9])}
    keys, n = toxicity.entries(spark.createDataFrame(list(counts.items()), "key bigint, n bigint"), most)
    assert list(keys) == sorted(keys) and len(keys) <= most and all(counts[k] == x for k, x in zip(keys.tolist(), n.tolist(), strict=True))
    # The most frequent ones stay, all of a power of two or none.
    assert len(keys) == len(counts) or min(n, default=10**10) > max([x for k, x in counts.items() if k not in keys], default=0)


def test_rare_sequences_beyond_the_table_are_counted_exactly(spark):
    """A table that holds few entries gives the counts of one that holds all."""
    texts = [("the idiot and the stupid moron " * 3,), ("ein Löwe, straße; 漢字 漢語 字漢",), ("pathetic scum, ids", )]
    whole, small = (toxicity.char_model(spark.createDataFrame(texts, "text string"), most=n) for n in (10**6, 5))
    assert not whole.rest and set(small.rest) == set(small.tables) and all(len(k) <= 5 for k, _ in small.tables.values())
    small = pickle.loads(pickle.dumps(small))
    assert small.total == whole.total
    for name, (keys, n) in whole.tables.items():
        assert [small.count(name, k) for k in keys.tolist()] == n.tolist() and small.count(name, 7) == 0
    for gram in ("idi", "^th", "漢語$", "Lxz", "aße"):
        assert small.log(*gram[:3]) == whole.log(*gram[:3])


def test_frames_of_a_shard_are_opened_one_by_one():
    """No frame is asked for before the one before it is given out, and no frame is held whole."""
    asked = []

    def frames():
        for k in range(3):
            asked.append(k)
            yield k, token_shards.squeeze([(k, i, None, b"%d" % i) for i in range(1200)])

    for n, (shard, slot, start, doc_id, raw) in enumerate(token_shards.open_frames(frames())):
        assert asked[-1] == shard == slot == n // 1200 and (start, doc_id, raw) == (n % 1200, None, b"%d" % start)
    assert n == 3599 and list(token_shards.unsqueeze(token_shards.squeeze([]))) == []


def test_places_of_phrases_and_notices_in_one_text():
    scanner = licenses.Scanner(licenses.NOTICES)
    text = " ".join(["a CC BY licence"] * 300 + ["released under teh mit license; üm"] * 40 + ["all rights reserved"])
    out, words = scanner.scan(text), licenses.words_of(text)
    at = lambda phrase: [i for i in range(len(words)) if [w.decode() for w in words[i : i + len(phrase)]] == phrase]
    assert out["n_base"] == 301 and (out["first_word"], out["last_word"]) == (1, at(["all", "rights", "reserved"])[0])
    mit = [s for s in out["spans"] if s["label"] == "mit"]
    assert [s["start"] for s in sorted(mit, key=lambda s: s["start"])] == at(["released", "under", "teh"]) and {s["end"] - s["start"] for s in mit} == {5}


def test_tokens_without_evidence_are_not_decoded(monkeypatch):
    rng = random.Random(5)
    grams = {k: (np.array([ord(c) for c in "abdilost"]), np.full(8, 9)) for k in ("one", "heads")} | {k: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for k in ("three", "two", "pairs")}
    reader = toxicity.Reader(toxicity.CharModel(grams), {"=idiot": 0.9, "=ass": 0.8, "=b": 0.7, "stoo": 0.6, "lost": 0.5})
    tokens = {"".join(rng.choice("abdiloosst1!@.ßI") for _ in range(rng.randrange(1, 9))) for _ in range(20_000)} | {"idiiot", "asss!", "(bb,", "stool", "Stoool", "LLoosst"}
    silent = {t for t in tokens if reader.silent(t)}
    assert len(silent) > 1000 and not any(reader.best(toxicity.restore(reader.model, t)) for t in silent)
    assert all(reader.evidence(t) for t in ("idiiot", "stool", "bb,"))
    monkeypatch.setattr(toxicity, "restore", lambda *_: 1 / 0)
    assert toxicity.Reader(reader.model, reader.weight).evidence("Total doom, cool: dull") == {}
