"""Forest properties, chain tampering, packets, and chunk parsing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fleetstream.config import WINDOW_FEATURES
from fleetstream.operators import anomaly, audit, baselines, eta, knowledge


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(0, 1, (800, len(WINDOW_FEATURES))), columns=list(WINDOW_FEATURES))
    pdf.loc[:4] += 9
    pdf["window_id"] = [f"w{i:04d}" for i in range(len(pdf))]
    pdf["working_ratio"], pdf["cycle_count"] = 0.9, 3
    return spark.createDataFrame(pdf)


def test_forest_flags_extremes(cloud):
    forest = anomaly.fit_forest(cloud.where("window_id >= 'w0005'"), trees=60, sample=128)
    sizes = forest.where("node = 0").select("size").toPandas()["size"]
    assert len(sizes) == 60 and sizes.eq(128).all()
    s = anomaly.forest_scores(cloud, forest).select("window_id", "raw_score").toPandas().set_index("window_id")["raw_score"]
    assert s.between(0, 1).all()
    assert s[[f"w{i:04d}" for i in range(5)]].min() > s.drop([f"w{i:04d}" for i in range(5)]).quantile(0.99)


def test_forest_is_deterministic(cloud):
    a, b = (anomaly.fit_forest(cloud.repartition(n), trees=5, sample=64).toPandas().sort_values(["tree", "node"]).reset_index(drop=True) for n in (1, 7))
    pd.testing.assert_frame_equal(a, b)


def test_chain_append_continues_and_tampering_is_found(spark):
    rows = [("c", i, "u", "A", "t", f"x{i}", "p" * 64) for i in range(1, 9)]
    e = spark.createDataFrame(rows, "chain_id string, id long, actor_id string, action string, target_type string, target_id string, payload_hash string")
    e = e.withColumn("ts", F.timestamp_micros(F.lit(1767225600123456) + F.col("id")))
    whole = audit.append_chain(e)
    first = audit.append_chain(e.where("id <= 3"))
    rest = audit.append_chain(e.where("id > 3"), audit.latest_heads(first))
    cols = ["id", "prev_hash", "current_hash"]
    assert sorted(map(str, whole.select(*cols).collect())) == sorted(map(str, first.unionByName(rest).select(*cols).collect()))
    assert audit.verify_chain(whole, block=2).first().is_valid
    bad = audit.verify_chain(whole.withColumn("action", F.when(F.col("id") == 5, "B").otherwise(F.col("action"))), block=2).first()
    assert (bad.is_valid, bad.first_invalid_id, bad.reason) == (False, 5, "HASH")
    gone = audit.verify_chain(whole.where("id <> 4"), block=2).first()
    assert (gone.first_invalid_id, gone.reason) == (5, "LINK")
    with pytest.raises(ValueError):
        audit.append_chain(e, max_chain=5)


def test_chunks_without_front_matter_and_with_preamble(spark):
    d = spark.createDataFrame([("plain", "intro\n## First Part\nbody one\n\n## Second\n"), ("x", "---\ntitle: T\ntags: [A, B]\n---\n## Only\ntext\n")], "file_stem string, raw string")
    got = {r.chunk_id: r for r in knowledge.chunk_documents(d).collect()}
    assert set(got) == {"plain#first-part", "plain#second", "x#only"}
    assert got["plain#first-part"].text == "body one" and got["plain#second"].text == ""
    assert (got["x#only"].title, got["x#only"].tags) == ("T", ["A", "B"])


def test_search_pads_with_zero_scores(spark):
    docs = [(f"d{i}", f"## H{i}\n" + ("alpha beta " if i == 3 else "gamma ") * 3) for i in range(6)]
    chunks = knowledge.chunk_documents(spark.createDataFrame(docs, "file_stem string, raw string"))
    q = spark.createDataFrame([("q", "alpha", ["X"]), ("none", "zzz", [])], "query_id string, query string, tags array<string>")
    got = knowledge.bm25_search(q, chunks, knowledge.search_index(*knowledge.bm25_index(chunks)), 3, pad=True).collect()
    assert [r.chunk_id for r in sorted((r for r in got if r.query_id == "q"), key=lambda r: r["rank"])] == ["d3#h3", "d0#h0", "d1#h1"]
    assert [r.chunk_id for r in sorted((r for r in got if r.query_id == "none"), key=lambda r: r["rank"])] == ["d0#h0", "d1#h1", "d2#h2"]
    with pytest.raises(ValueError):
        knowledge.check_unique(chunks.unionByName(chunks))


def test_chunks_of_ids_without_a_separator(spark):
    """Ids of no machine are cut by a beginning that never falls along them, with many rows to a chunk."""
    ids = [f"W{i}-{i % 7 + 1}-{i * 13}" for i in range(1, 4000)]
    d = spark.createDataFrame([(i,) for i in ids], "window_id string")
    got = sorted((r.window_id, r.p) for r in d.withColumn("p", baselines.id_part(d, "window_id")).collect())
    parts = [p for _, p in got]
    assert parts == sorted(parts) and 50 < len(set(parts)) <= 200
    e = spark.createDataFrame([(f"M{i % 30}:{i}",) for i in range(300)], "window_id string")
    assert e.withColumn("p", baselines.id_part(e, "window_id")).select("p").distinct().count() == 30
    same = spark.createDataFrame([("W1",), ("W1",)], "window_id string")
    assert {r.p for r in same.withColumn("p", baselines.id_part(same, "window_id")).collect()} == {"W1"}


def test_ewma_equals_the_plain_fold(spark):
    rows, want = [], {}
    for n in (1, 399, 400, 401, 3000):
        values = [1.0] * (5 * n // 6) + [0.0] * (n - 5 * n // 6)
        rows += [(str(n), i // 100, f"M{i % 100 // 10}:{i:05d}", v) for i, v in enumerate(values)]
        want[str(n)] = values
    d = spark.createDataFrame(rows, "key string, dd int, window_id string, v double")
    for alpha in (0.1, 0.01, 0.002):
        for parts in (None, [F.col("dd"), F.concat(F.substring_index("window_id", ":", 1), F.lit(":"))]):
            got = {r.key: r.ewma for r in baselines.ewma_last(d, ["key"], "v", ["dd", "window_id"], alpha, parts).collect()}
            for key, values in want.items():
                fold = values[0]
                for v in values[1:]:
                    fold = alpha * v + (1 - alpha) * fold
                assert abs(got[key] - fold) < 1e-12


def test_forest_in_blocks_scores_the_same(cloud):
    forest = anomaly.fit_forest(cloud, trees=12, sample=64, seed=3)
    one, many = (anomaly.forest_scores(cloud, forest, n).select("window_id", "raw_score").toPandas().set_index("window_id")["raw_score"].sort_index() for n in (10**6, 150))
    assert one.notna().any() and ((one - many).abs().fillna(0) < 1e-12).all() and (one.isna() == many.isna()).all()


def test_medians_of_null_keys_and_keys_named_like_results(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0), (None, 7.0)], "k string, v double")
    got = {r.k: (r.n, r["median"], r.mad) for r in baselines.medians(d, ["k"], "v").collect()}
    assert got == {"a": (2, 2.0, 1.0), None: (3, 7.0, 2.0)}


@pytest.mark.parametrize("kind", ["mllib", "quantile"])
def test_factors_equal_all_coalitions_without_making_them(spark, kind):
    """Grouped Shapley values from leaves are those of predictions on every mix of a row with every background row."""
    from itertools import permutations

    rng = np.random.default_rng(4)
    n = 400
    frame = pd.DataFrame({
        "task_id": [f"t{i:03d}" for i in range(n)], "task_type": rng.choice(["GRADING", "TRENCHING"], n), "weather": rng.choice(["SUNNY", "RAIN"], n), "ground": rng.choice(["DRY", "ICY", "WET"], n),
        "operator_skill": rng.choice(["EXPERT", "BEGINNER"], n), "machine_type": rng.choice(["LOADER", "EXCAVATOR"], n), "target_cycles": rng.integers(20, 80, n).astype(float),
        "machine_age_years": rng.integers(1, 6, n).astype(float), "wind_kmh": rng.integers(0, 60, n).astype(float), "hauler_queue_mean": rng.integers(0, 4, n).astype(float),
        "rainfall_mm_h": 0.0, "visibility_m": 9999.0, "ambient_temp_c": rng.integers(5, 30, n).astype(float), "split": np.where(np.arange(n) % 5 == 0, "val", "train"),
    })
    slow = (frame["ground"] == "ICY") * (frame["operator_skill"] == "BEGINNER")
    frame["actual_min"] = frame["target_cycles"] * (1 + 0.5 * slow + 0.01 * frame["wind_kmh"] * (frame["weather"] == "RAIN")) + 5 * frame["hauler_queue_mean"]
    history = spark.createDataFrame(frame)
    model = eta.fit_eta(history, 3, 3, 0.5) if kind == "mllib" else eta.fit_eta_quantiles(history, 3, 3, 0.5, 3)
    tasks = history.where("task_id < 't006'").drop("split").unionByName(spark.createDataFrame([("odd", "UNKNOWN")], "task_id string, task_type string"), allowMissingColumns=True)
    got = eta.explain_eta(tasks, model, history, background=7)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()

    encode = lambda d: {r.task_id: (r.task_type, r.x) for r in eta.feature_row(d).select("task_id", "task_type", eta.encoded().alias("x")).collect()}
    base = encode(baselines.sample_per_group(history.where("split = 'train'"), "task_type", "task_id", 7, 42))
    names = list(eta.FACTOR_GROUPS)
    owner = {f: i for i, g in enumerate(names) for f in eta.FACTOR_GROUPS[g]}
    group = np.array([owner[f.split("__")[0]] for f in eta.FEATURE_COLUMNS])
    rows = got.collect()
    assert sorted(r.task_id for r in rows) == [f"t{i:03d}" for i in range(6)]
    x = encode(tasks)
    mixed, at = [], []
    for r in rows[:3]:
        kind_of, own = x[r.task_id]
        for s in range(64):
            for t, b in base.values():
                if t == kind_of:
                    mixed.append(np.where(s >> group & 1, own, b).tolist())
                    at.append((r.task_id, s))
    if kind == "mllib":
        value = [model.predict(Vectors.dense(m)) for m in mixed]
    else:
        value = model.only(0.5).predict(np.array(mixed))[:, 0]
    mean = pd.DataFrame({"at": at, "v": value}).groupby("at")["v"].mean()
    for r in rows[:3]:
        v = [mean[(r.task_id, s)] for s in range(64)]
        want = np.zeros(6)
        for order in permutations(range(6)):
            s = 0
            for g in order:
                want[g] += (v[s | 1 << g] - v[s]) / 720
                s |= 1 << g
        assert np.allclose(r.minutes, want) and abs(r.p50_min - v[63]) < 0.0051 and abs(r.base_value_min - v[0]) < 0.0051
        assert abs(r.base_value_min + sum(f.minutes for f in r.factors) - r.p50_min) < 0.005


def test_factors_come_from_the_whole_model(spark, pipe, monkeypatch):
    """e6_factors explains median trees of all rounds until they stop, not a few rounds of shallow ones."""
    from fleetstream.plans import q_models, registry

    used = []
    explain = eta.explain_eta
    monkeypatch.setattr(eta, "explain_eta", lambda tasks, model, *a, **k: used.append(model) or explain(tasks, model, *a, **k))
    rows = registry.queries()["e6_factors"](spark, pipe.sf_dir).collect()
    assert rows and all(r.n_factors == 6 and r.adds_up for r in rows)
    (model,) = used
    assert len(eta._paths(model)[1]) > 100 and model.depth == 6
    # the trees stop where the validation loss is least
    few = eta.fit_eta_quantiles(pipe.t("eta_split"), 10, 5, 0.3, 5, (0.5,))
    assert model.loss[0] < few.loss[0] and q_models._median(pipe) is model
