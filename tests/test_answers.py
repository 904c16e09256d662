"""Fingerprints, record lines in batch and stream, the stored index, context rows, short quotes, words beside accents."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tests.oracle import DATA
from tidemark.functions import text as ft
from tidemark.operators import links, policies, retrieval
from tidemark.plans import answers
from tidemark.sources.text import parsed_lines


def test_fingerprints_do_not_depend_on_order(spark):
    rng = random.Random(1)

    def shuffled(v):
        if isinstance(v, dict):
            keys = list(v)
            rng.shuffle(keys)
            return {k: shuffled(v[k]) for k in keys}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    value = {"b": {"y": 2.5, "x": [1, {"q": None, "a": True}]}, "a": "é\n\"", "ä": [], "A": {}}
    changed = [{**value, "a": "e"}, {**value, "b": {**value["b"], "x": [{"q": None, "a": True}, 1]}}, {k: v for k, v in value.items() if k != "A"}]
    rows = [(0, json.dumps(shuffled(value), indent=rng.choice((None, 2)), ensure_ascii=rng.random() < 0.5)) for _ in range(8)] + [(i + 1, json.dumps(c)) for i, c in enumerate(changed)]
    got = {}
    for r in spark.createDataFrame(rows, "k int, j string").select("k", ft.fingerprint(F.col("j")).alias("f")).collect():
        got.setdefault(r.k, set()).add(r.f)
    assert all(len(v) == 1 for v in got.values()) and len({f for v in got.values() for f in v}) == 4
    assert got[0] == {hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()}
    bad = ['{"a": NaN}', '{"a": 1} tail', "1],[2", '{"a": 1', "", "1}"]
    assert [r[0] for r in spark.createDataFrame([(b,) for b in bad], "j string").select(ft.canonical_json(F.col("j"))).collect()] == [None] * len(bad)


LINES = StructType().add("id", "long").add("at", "string")
FILES = {"a": '{"id": 1, "at": "x"}\n\nbroken\n{"id": 2}\n{"id": "no"}\n{"id": 3, "x": 1}\n{"id": 4, "at": "y"', "b": "", "c": '{"id": 5}\r\n[1]\n{"id": Infinity}\n'}


def test_batch_and_stream_reject_the_same_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, (name, text) in enumerate(FILES.items()):
        (folder / name).write_text(text, newline="")
        os.utime(folder / name, (k + 1, k + 1))
    named = lambda d: d.select(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("file"), "value")
    batch = parsed_lines(named(spark.read.text(str(folder), wholetext=True)), LINES, torn_tail=True)
    got = {(r.file, r.line): (r.row.id if r.row else None, r.problem) for r in batch.collect()}
    assert got == {("a", 1): (1, None), ("a", 3): (None, "not JSON"), ("a", 4): (2, None), ("a", 5): (None, "wrong type"), ("a", 6): (None, "unknown field"), ("c", 1): (5, None), ("c", 2): (None, "not an object"), ("c", 3): (None, "not JSON")}
    stream = parsed_lines(named(spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder), wholetext=True)), LINES, torn_tail=True)

    def write(rows, _):
        rows.where("problem is null").select("file", "line", "row.*").write.mode("append").parquet(str(tmp_path / "good"))
        rows.where("problem is not null").select("file", "line", "raw", "problem").write.mode("append").parquet(str(tmp_path / "bad"))

    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(200)
    good = {(r.file, r.line): (r.id, None) for r in spark.read.parquet(str(tmp_path / "good")).collect()}
    bad = {(r.file, r.line): (None, r.problem) for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert good | bad == got


def test_index_after_an_append_equals_a_rebuild(spark, tmp_path):
    q, p = answers._search(spark, DATA)
    p = p.where("run_id < 60")
    grown, whole = (retrieval.StoredIndex(spark, f"file://{tmp_path}/{n}") for n in ("grown", "whole"))
    assert grown.search(q).collect() == []
    for part in (0, 1, 2, 1):
        grown.append(p.where(F.col("run_id") % 3 == part).select("run_id", "passage", "text"))
    whole.append(p.select("run_id", "passage", "text"))
    rows = lambda d: sorted((str(r.run_id), r.query_id, r.passage, r.score, r.matched) for r in d.collect())
    found = rows(grown.search(q))
    assert found and found == rows(whole.search(q)) == rows(retrieval.bm25(q.where("run_id < 60"), p))
    # Postings of a load that broke off before its runs were named are not read.
    retrieval.index(p.limit(5).select("run_id", "passage", "text")).select(F.lit("new").alias("run_id"), F.col("passage").cast("bigint").alias("passage"), "term", "tf", "length", F.lit("lost").alias("load"), grown.bucket(F.col("term")).alias("bucket")).write.partitionBy("bucket").mode("append").parquet(f"file://{tmp_path}/grown/postings")
    assert rows(grown.search(q)) == found


def test_context_is_a_whole_beginning(spark):
    a = spark.createDataFrame([("r", 0, 5, "b" * 10), ("r", 0, 1, "a" * 10), ("s", 0, 0, "x" * 50)], "run_id string, query_id int, at int, text string")
    b = spark.createDataFrame([("r", 0, 0, "c" * 20), ("r", 0, 9, "d"), ("s", 0, 0, "y")], a.schema)
    got = [tuple(r) for r in retrieval.context_rows([a, b], 39).orderBy("run_id", "place").collect()]
    assert got == [("r", 0, 0, 1, "a" * 10), ("r", 0, 0, 2, "b" * 10)]
    assert retrieval.context_rows([a, b], 40).count() == 3


def test_short_quotes_equal_a_scan(spark):
    rng = random.Random(3)
    segs = [(r, i, " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(5))) for r in range(4) for i in range(12)]
    quotes = [(r, i, "".join(rng.choice("abc  ") for _ in range(rng.randrange(0, 8)))) for r in range(5) for i in range(30)]
    got = {(r.run_id, r.quote_id): r.seg_idx for r in links.exact_quotes(spark.createDataFrame(quotes, "run_id int, quote_id int, quote string"), spark.createDataFrame(segs, "run_id int, seg_idx int, text string")).collect()}
    for r, i, quote in quotes:
        q = " ".join(quote.split())
        want = min((k for s, k, t in segs if s == r and q and q in t), default=None)
        assert got[r, i] == want


def test_words_end_at_letters_of_any_script(spark):
    d = spark.createDataFrame([("Doó this", False), ("Doñar y", False), ("Do this", True), ("édo it", False), ("we do", False)], "t string, want boolean")
    assert all(r.got == r.want for r in d.select("want", F.col("t").rlike(ft.edges(ft.QUESTION)).alias("got")).collect())
    assert spark.createDataFrame([("la músicamusic",), ("música",), ("music!",)], "t string").where(policies.banned_reason(F.col("t")).isNotNull()).count() == 1


@pytest.mark.parametrize(("kind", "names"), [("video", ["hook", "filler_rate", "speech_rate"]), ("script", ["hook", "speech_rate"])])
def test_scripts_have_no_speech_signals(spark, kind, names):
    d = spark.createDataFrame([(n, "speech") for n in ("hook", "filler_rate", "speech_rate")], "name string, modality string")
    out = policies.script_signals(d, kind).collect()
    assert [r.name for r in out] == names and {r.modality for r in out} == {"text" if kind == "script" else "speech"}


def test_terms_before_their_definition_equal_a_scan(spark):
    import re

    from tidemark.operators import sentences

    rng, words, rows = random.Random(2), ["grid", "grid-lock", "o'er", "flow", "flow state", "big-o"], []
    for r in range(6):
        for i in range(30):
            t = " ".join(rng.choice(words) for _ in range(rng.randrange(2, 6)))
            rows.append((r, i, i * 1000, i * 1000 + 900, (f"It is called {rng.choice(words)} {rng.choice(words)}, really." if rng.random() < 0.3 else t).capitalize()))
    d = spark.createDataFrame(rows, "run_id int, sent int, start_ms bigint, end_ms bigint, text string")
    want = []
    for x in d.select("run_id", "sent", F.explode(F.regexp_extract_all("text", F.lit(ft.edges(ft.DEFINITION)), F.lit(1))).alias("t")).collect():
        term = x.t.lower().strip()
        used = [k for r, k, _, _, t in rows if r == x.run_id and k < x.sent and re.search(rf"\b{term}\b", t.lower())]
        if used and 2 <= len(term.split()) <= 4:
            want.append((x.run_id, term, x.sent, min(used)))
    got = sorted((x.run_id, x.term, x.explained, x.used) for x in sentences.term_dependencies(d).collect())
    assert got == sorted(want) and len(got) > 10
