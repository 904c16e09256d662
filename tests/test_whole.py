"""Whole runs as arrays: one exchange a plan, the rows of the SQL, and runs that cross batches."""

import pyarrow as pa
import pytest

from tests.oracle import DATA
from tests.test_large_runs import moved, over
from tidemark.operators import merges, whole
from tidemark.plans.catalogue import QUERIES

SAY = ["Quantum engines rotate slowly beside purple mountains today.", "Seven tired wizards paint enormous ceilings every winter.", "A wholly different remark about coffee beans follows, um, uh, um."]
DOCS = [("\n".join([*SAY, *SAY[:2], f"Um, {i} uh, basically, you know."]) + "\n") * 3 for i in range(3)] + ["", "one", "Wörter 世界 " * 400]


@pytest.mark.parametrize("name", ["r01_feature_findings", "r03_structure_findings", "a04_text_risk", "a05_risk_per_second", "j16_attached_findings", "e04_low_novelty", "w17_novelty", "e05_repetition_runs", "j08_best_earlier"])
def test_findings_ask_for_one_exchange(spark, name):
    plan = QUERIES[name](spark, DATA)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert len(moved(plan)) == 1 and "Broadcast" not in text and "Join" not in text


@pytest.mark.parametrize("name", ["r01_feature_findings", "r03_structure_findings", "a04_text_risk", "e04_low_novelty", "w17_novelty", "e05_repetition_runs", "j08_best_earlier"])
def test_odd_documents(spark, tmp_path, name):
    got, want = over(spark, tmp_path, name, documents=[{"doc_id": i, "text": x} for i, x in enumerate(DOCS)])
    assert got == want


def test_full_analysis_has_every_rule(spark, tmp_path):
    """Repeated passages and fillers are findings, too."""
    import pandas as pd

    pd.DataFrame([{"doc_id": i, "text": x} for i, x in enumerate(DOCS)]).to_parquet(f"{tmp_path}/documents.parquet", index=False)
    rows = QUERIES["r27_full_analysis"](spark, str(tmp_path)).collect()
    assert {"repetition", "filler_density", "topic_drift", "unconfirmed_title_promise"} <= {r.rule for r in rows}
    assert len({(r.run_id, r.finding_id) for r in rows}) == len(rows)


def test_the_strongest_of_equal_findings_stays(spark):
    x = spark.createDataFrame([(1, "a", "low"), (1, "a", "high"), (1, "a", "medium"), (2, "a", "low")], "run_id int, finding_id string, severity string")
    assert sorted((r.run_id, r.severity) for r in merges.strongest(x).collect()) == [(1, "high"), (2, "low")]


def test_runs_that_cross_batches_stay_whole():
    ids = [1, 1, 2, 3, 3, 3, 3, 3, 4]
    for size in range(1, 10):
        batches = [pa.RecordBatch.from_pydict({"run_id": ids[i : i + size], "x": list(range(i, min(9, i + size)))}) for i in range(0, 9, size)]
        tables = [t.to_pydict() for t in whole.whole_runs(batches)]
        assert [x for t in tables for x in t["run_id"]] == ids and [x for t in tables for x in t["x"]] == list(range(9))
        assert sum(len(set(t["run_id"])) for t in tables) == 4


def test_best_earlier_is_that_of_all_pairs(monkeypatch):
    """However many pairs are counted at once."""
    import random

    import numpy as np

    for trial in range(60):
        random.seed(trial)
        lines = [[random.randint(0, 4) for _ in range(random.randint(0, 7))] for _ in range(random.randint(1, 14))]
        runs, want = [{tuple(x[i : i + 3]) for i in range(len(x) - 2)} for x in lines], {}
        for i, x in enumerate(runs):
            found = [(-len(x & y) / len(x), j) for j, y in enumerate(runs[:i]) if x & y]
            if found:
                want[i] = (min(found)[1], -min(found)[0])
        at = np.concatenate(([0], np.cumsum([len(x) for x in lines]))).astype(np.int64)
        s = whole.Segments(1, {"seg_idx": np.arange(len(lines)), "b": np.arange(len(lines)) + 1, "tokens": whole.Ragged(at, np.array([c for x in lines for c in x], np.int64))})
        monkeypatch.setattr(whole, "PAIRS", (1, 5, 1 << 21)[trial % 3])
        assert {int(i): (int(j), float(v)) for i, j, v in zip(*whole.best_earlier(s), strict=True)} == want
