import random
import zlib

import numpy as np
import pytest

from fleetstream.llm import toxicity
from fleetstream.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    assert len(rows) == docs.count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    marks = [(r.toxic, rows[r.doc_id].predicted) for r in labels.collect() if rows[r.doc_id].held_out]
    caught, alarms = [p for t, p in marks if t], [p for t, p in marks if not t]
    assert np.mean(caught) > 0.85 and np.mean(alarms) < 0.04


def test_held_out_labels_change_nothing(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices("red green blue grey".split(), k=20) + (["vile", "vile"] if i % 4 == 0 else []))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = zlib.crc32
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    flipped = [(i, 1 - t if out(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.weights == b.weights and a.bias == b.bias
    assert a.score("a vile thing") > 0.5 > a.score("a blue thing")


def test_the_risk_is_held_at_zero():
    # without the correction the fit drives the estimate of the clean risk below zero
    rng = np.random.default_rng(0)
    positive = [np.sort(rng.choice(300, 12, replace=False)) for _ in range(30)]
    unlabelled = [np.sort(rng.choice(300, 12, replace=False)) for _ in range(200)] + positive[:20]
    w, b = toxicity.fit(positive, unlabelled, 300, 0.3)
    z = lambda rows: np.array([w[r].sum() + b for r in rows])
    risk = np.logaddexp(0, z(unlabelled)).mean() - 0.3 * np.logaddexp(0, z(positive)).mean()
    assert risk > -0.05


def test_odd_rows(spark):
    model = toxicity.Model({"vile": 3.0, "stup-": 2.0}, -2.0)
    rows = [(1, None), (2, ""), (3, " \n"), (None, "Vile!"), (5, "stupendous " * 50000), (6, "vile"), (6, "vile")]
    docs = spark.createDataFrame([(i, t, 0.3) for i, t in rows], "doc_id long, text string, score double")
    got = toxicity.scores(docs, model).collect()
    calm = 1 / (1 + np.exp(2))
    assert sorted(round(r.score, 6) for r in got) == sorted(round(x, 6) for x in [calm] * 3 + [1 / (1 + np.exp(-1))] * 3 + [0.5])
    assert toxicity.scores(docs.limit(0), model).count() == 0
    none = toxicity.train(docs, spark.createDataFrame([(2, 0), (None, 1), (6, None)], "doc_id long, toxic int"))
    assert none.weights == {}
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int")).bias == pytest.approx(np.log(0.001 / 0.999))
