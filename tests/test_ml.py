import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowsentry.ml import anomaly as MA
from flowsentry.ml import metrics as MM
from flowsentry.ml import persist as MP
from flowsentry.ml.detectors import Settings, feature_importance, fit_detector, score, score_all
from flowsentry.ml.features import feature_matrix
from flowsentry.ml.vote import ensemble_vote
from flowsentry.operators.connections import flow_features
from flowsentry.plans.detection import predict_flows, train_and_save, train_detectors, training_frame
from flowsentry.schemas import DETECTORS, FLOW_FEATURES, FLOW_LABEL
from flowsentry.sources import derived as D
from flowsentry.sources.tables import table

TINY = Settings(trees=5, depth=6, svm_iterations=3, fourier_size=16, boosting_rounds=2, boosting_depth=3,
                network_iterations=10)
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def flows(spark):
    return D.flows(table(spark, FOLDER, "lineitem"))


@pytest.fixture(scope="module")
def split(flows):
    return training_frame(flows, D.FLOW_ROW_KEY)


@pytest.fixture(scope="module")
def models(split):
    return train_detectors(split, settings=TINY)


def votes(spark, *rows):
    labels = ", ".join(f"{d} string" for d in DETECTORS)
    scores = ", ".join(f"{d}_confidence double" for d in DETECTORS)
    data = [(i, *labels_, *confidences) for i, (labels_, confidences) in enumerate(rows)]
    df = spark.createDataFrame(data, f"id int, {labels}, {scores}")
    return ensemble_vote(df, keep=["id"]).orderBy("id").collect()


def test_vote_majority_ties_and_missing(spark):
    got = votes(
        spark,
        (("DoS", "Normal", "DoS", "Normal"), (0.5, 0.9, 0.7, 0.9)),     # tie: the first detector's label
        (("a", "b", "c", "d"), (0.1, 0.2, 0.3, 0.4)),                   # all different
        ((None, "Normal", "DoS", "DoS"), (None, 0.9, 0.5, 1.0)),        # one missing
        ((None, None, None, None), (None, None, None, None)),           # none
        (("x", "Normal", "normal", "Normal"), (0.4, 0.5, 0.5, 0.6)))
    assert [(r.prediction, r.threat_level, r.confidence) for r in got] == [
        ("DoS", "DANGER", 0.6), ("a", "DANGER", 0.1), ("DoS", "DANGER", 0.75), ("Unknown", None, 0.0),
        ("Normal", "SAFE", 0.55)]
    assert got[0].votes == {"DoS": 2, "Normal": 2}
    assert got[0].details == ("Majority Vote: DoS (2/4). random_forest: DoS (0.50), svm: Normal (0.90), "
                              "xgboost: DoS (0.70), cnn: Normal (0.90)")
    assert got[2].details.startswith("Majority Vote: DoS (2/3). svm: Normal")
    assert got[2].models_used == {"random_forest": False, "svm": True, "xgboost": True, "cnn": True}
    assert got[3].details == "No models available" and got[3].votes == {}


def test_metrics_agree_with_the_evaluator(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("c", "c"), ("a", "a")]
    df = spark.createDataFrame(pairs, "t string, p string")
    got = MM.weighted_metrics(df, "t", "p").first()
    index = {"a": 0.0, "b": 1.0, "c": 2.0}
    numbers = spark.createDataFrame([(index[t], index[p]) for t, p in pairs], "label double, prediction double")
    for ours, theirs in (("accuracy", "accuracy"), ("precision", "weightedPrecision"),
                         ("recall", "weightedRecall"), ("f1_score", "f1")):
        judge = MulticlassClassificationEvaluator(metricName=theirs)
        assert got[ours] == pytest.approx(judge.evaluate(numbers))


def test_class_never_predicted_or_never_true(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("a", "x")], "t string, p string")
    got = {r.label: tuple(r)[1:] for r in MM.class_report(df, "t", "p").collect()}
    assert got["b"] == (0.0, 0.0, 0.0, 1) and got["x"] == (0.0, 0.0, 0.0, 0)


def test_majority_class_gives_the_known_floor(spark):
    df = spark.createDataFrame([("n" if i < 7 else "a", "n") for i in range(10)], "t string, p string")
    got = MM.weighted_metrics(df, "t", "p").first()
    assert (got.accuracy, got.recall) == (0.7, 0.7)
    assert got.precision == pytest.approx(0.49) and got.f1_score == pytest.approx(0.576470588)


def test_every_detector_beats_nothing_and_forest_beats_the_majority(split, models):
    assert set(models) == set(DETECTORS)
    scored = score_all(models, split)
    row = scored.first()
    assert all(row[d] and 0 < row[f"{d}_confidence"] <= 1 for d in DETECTORS)
    test = scored.filter("split = 'test'")
    floor = test.groupBy(FLOW_LABEL).count().agg((F.max("count") / F.sum("count")).alias("f")).first().f
    accuracy = {r.model: r.accuracy for r in MM.model_report(test, FLOW_LABEL, DETECTORS).collect()}
    assert accuracy["random_forest"] > floor and accuracy["xgboost"] > floor


def test_saved_detectors_give_the_same_labels(spark, split, models, tmp_path):
    for detector in ("random_forest", "svm"):
        MP.save_detector(models[detector], spark, str(tmp_path), detector, FLOW_FEATURES, {"accuracy": 1.0})
        loaded, notes = MP.load_detector(spark, str(tmp_path), detector)
        assert notes["feature_names"] == FLOW_FEATURES
        ours = score(models[detector], split, detector).select(*D.FLOW_ROW_KEY, detector)
        theirs = score(loaded, split, detector).select(*D.FLOW_ROW_KEY, detector)
        assert ours.exceptAll(theirs).count() == 0
    gone = []
    assert set(MP.load_detectors(spark, str(tmp_path), missing=gone)) == {"random_forest", "svm"}
    assert gone == ["xgboost", "cnn"]
    with pytest.raises(Exception):
        MP.load_detectors(spark, str(tmp_path))


def test_importances(spark, models):
    top = feature_importance(models["random_forest"], spark, top=3).collect()
    assert len(top) == 3 and top[0].importance >= top[1].importance
    assert {r.feature for r in top} & {"PacketSize", "PayloadSize", "AnomalyScore"}


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(0.0, "a"), (2.0, "b")] * 3, "x double, y string")
    model = fit_detector(df, "random_forest", TINY, ["x"], "y")
    scaled = model.transform(df).select("_random_forest_features").first()[0]
    assert abs(scaled[0]) == pytest.approx(1.0)


def test_train_save_and_predict(spark, flows, tmp_path):
    results = train_and_save(flows, D.FLOW_ROW_KEY, str(tmp_path), ["random_forest"], TINY)
    assert results["random_forest"]["val_accuracy"] > 0.5
    models = MP.load_detectors(spark, str(tmp_path), ["random_forest"])
    packets = D.packets(table(spark, FOLDER, "events"))
    fresh = flow_features(packets)
    got = predict_flows(fresh.withColumn("port", F.col("DstPort")), models, ["port"])
    assert got.count() == fresh.count()
    assert got.filter("protection_advice IS NULL").count() == 0


def test_missing_columns_are_zero_when_scoring(spark, models):
    bare = feature_matrix(spark.createDataFrame([("10.0.0.1",)], "SrcIP string"))
    assert bare.first().asDict()["SrcIP"] == 10 << 24 | 1 and bare.first().PacketSize == 0.0
    assert score(models["random_forest"], bare, "random_forest").first().random_forest


def test_anomaly_detector(spark, tmp_path):
    rows = spark.range(400).selectExpr(
        "id", "cast(id % 20 as double) a", "cast(id % 20 as double) * 2 + (id % 3) * 0.01 b", "5.0 c",
        "rand(1) d")
    odd = spark.createDataFrame([(1000, 1.0, -80.0, 5.0, 0.5)], "id long, a double, b double, c double, d double")
    assemble = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform
    detector = MA.fit_anomaly_detector(assemble(rows), size=2)
    assert detector.threshold == pytest.approx(detector.mean_error + 2 * detector.std_error)
    verdict = MA.anomaly_verdicts(detector, assemble(odd), ["id"]).first()
    assert verdict.is_anomaly and verdict.status == "ANOMALY" and verdict.confidence == 1.0
    flagged = MA.anomaly_verdicts(detector, assemble(rows), ["id"]).filter("is_anomaly").count()
    assert flagged < 40
    assert len(MA.encoded_features(detector, assemble(odd), ["id"]).first().code) == 2
    MP.save_anomaly_detector(detector, spark, str(tmp_path))
    again = MA.anomaly_scores(MP.load_anomaly_detector(spark, str(tmp_path)), assemble(odd), []).first()
    assert again.anomaly_score == pytest.approx(verdict.anomaly_score)


def test_reconstruction_error_is_the_plain_one(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    data = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)],
                               "id int, a double, b double, c double, d double")
    vectors = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df)
    detector = MA.fit_anomaly_detector(vectors, size=2)
    got = [r.anomaly_score for r in MA.anomaly_scores(detector, vectors, ["id"]).orderBy("id").collect()]
    z = (data - data.mean(0)) / (data.std(0) + 1e-8)
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    expected = ((z - z @ axes[:2].T @ axes[:2]) ** 2).mean(1)
    assert got == pytest.approx(expected.tolist(), rel=1e-6)


def test_grid_search_covers_the_grid_and_marks_the_best(split):
    from flowsentry.ml import tuning as MT

    train = split.filter("split = 'train'").select(*FLOW_FEATURES, FLOW_LABEL)
    assert MT.GRID == {"numTrees": [100, 200], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2]}
    table_, best = MT.grid_search(train, {"numTrees": [2, 4], "maxDepth": [2, 6], "minInstancesPerNode": [1]}, folds=2)
    found = table_.collect()
    assert len(found) == 4 and sum(r.is_best for r in found) == 1
    top = max(found, key=lambda r: r.f1_mean)
    assert top.is_best and best == {n: top[n] for n in best} and all(0 < r.f1_mean <= 1 and r.f1_std >= 0 for r in found)


def test_cross_validation_leaves_each_fold_out_once(flows):
    from flowsentry.ml import tuning as MT
    from flowsentry.operators.profile import stratified_folds

    rows = feature_matrix(flows, keep=[*D.FLOW_ROW_KEY, FLOW_LABEL])
    found = MT.cross_validated_f1(stratified_folds(rows, FLOW_LABEL, D.FLOW_ROW_KEY, 3), 3, TINY).first()
    assert 0.6 < found.f1_mean <= 1 and 0 <= found.f1_std < 0.2


def test_bounded_fits_judge_every_row(flows, split, monkeypatch):
    from dataclasses import replace

    from flowsentry.ml import tuning as MT
    from flowsentry.operators.profile import stratified_folds

    rows = feature_matrix(flows, keep=[*D.FLOW_ROW_KEY, FLOW_LABEL])
    judged, fitted = [], []
    score_, fit_, draw_ = MT.score, MT.fit_detector, MT.bounded_sample
    monkeypatch.setattr(MT, "score", lambda m, df, *a: judged.append(df.count()) or score_(m, df, *a))
    monkeypatch.setattr(MT, "fit_detector", lambda df, *a: fitted.append(df.count()) or fit_(df, *a))
    monkeypatch.setattr(MT, "bounded_sample", lambda df, label, key, n: draw_(df, label, key, n, least=1))
    MT.cross_validated_f1(stratified_folds(rows, FLOW_LABEL, D.FLOW_ROW_KEY, 3), 3, replace(TINY, fit_rows=60), key=D.FLOW_ROW_KEY)
    assert sum(judged) == rows.count() and max(fitted) < rows.count() / 2

    train = split.filter("split = 'train'").select(*D.FLOW_ROW_KEY, *FLOW_FEATURES, FLOW_LABEL)
    seen = []
    evaluate = MT.MulticlassClassificationEvaluator.evaluate
    monkeypatch.setattr(MT.MulticlassClassificationEvaluator, "evaluate", lambda self, df: seen.append(df.count()) or evaluate(self, df))
    found = MT.grid_search(train, {"numTrees": [2, 3]}, folds=2, key=D.FLOW_ROW_KEY, fit_rows=60)[0].collect()
    assert sum(seen) == 2 * train.count() and len(found) == 2 and sum(r.is_best for r in found) == 1


def test_bounded_samples_keep_every_class(spark):
    from flowsentry.operators.profile import bounded_sample

    df = spark.range(20_000).selectExpr("id", "CASE WHEN id < 50 THEN 'rare' WHEN id % 4 = 0 THEN NULL ELSE 'b' END AS y")
    got = {r.y: r["count"] for r in bounded_sample(df, "y", ["id"], 2_000).groupBy("y").count().collect()}
    assert got["rare"] == 50 and 400 < got[None] < 600 and 1300 < got["b"] < 1700
    assert bounded_sample(df, "y", ["id"], 0).count() == bounded_sample(df, "y", ["id"], 20_000).count() == 20_000
    assert bounded_sample(df, "y", ["id"], 2_000).exceptAll(bounded_sample(df.repartition(3), "y", ["id"], 2_000)).count() == 0


def test_failures_are_raised_or_named(split, monkeypatch):
    from flowsentry.plans import detection

    def broken(*_):
        raise ValueError("no")

    monkeypatch.setattr(detection, "fit_detector", broken)
    with pytest.raises(ValueError):
        train_detectors(split, ["svm"], TINY)
    missing = {}
    assert train_detectors(split, ["svm"], TINY, missing) == {} and "no" in str(missing["svm"])


def test_detection_with_fitted_models_from_packets_to_blocklist(spark, models):
    from functools import partial

    from flowsentry.plans.detection import detect

    packets = D.packets(table(spark, FOLDER, "events"))
    blocked = spark.createDataFrame([("9.9.9.9",)], "ip string")
    predictions, alerts, listed = detect(packets, partial(lambda flows, keep, models: predict_flows(flows, models, keep),
                                                          models=models), blocked)
    danger = predictions.filter("threat_level = 'DANGER'").count()
    assert predictions.count() > danger and alerts.count() == danger
    assert sorted(r.id for r in alerts.collect()) == list(range(1, danger + 1))
    assert {r.ip for r in listed.collect()} == {"9.9.9.9"} | {r.source_ip for r in alerts.collect()}

    from flowsentry.sources.alert_table import AlertTable

    order = ("ts", *(f"flow_{c}" for c in ("SrcIP", "DstIP", "SrcPort", "DstPort", "Protocol")))
    table_ = AlertTable(spark, order=order)
    ids = []
    for _ in range(2):
        _, found, more = detect(packets, lambda flows, keep: predict_flows(flows, models, keep), blocked, into=table_)
        ids.append(sorted(r.id for r in found.collect()))
    assert ids == [list(range(1, danger + 1)), list(range(danger + 1, 2 * danger + 1))]
    assert more.exceptAll(listed).count() == 0 and table_.read().count() == 2 * danger


def test_quick_scoring_gives_what_the_fitted_stages_give(split, models):
    from pyspark.ml.functions import vector_to_array

    from flowsentry.ml.batched import quick

    once = split.join(split.groupBy(*D.FLOW_ROW_KEY).count().filter("count = 1"), D.FLOW_ROW_KEY, "left_semi")
    for detector, stages, near in (("random_forest", 5, 0.0), ("svm", 5, 1e-9)):
        said = score(models[detector], once, detector, probabilities=True)
        assert len(quick(models[detector], split.sparkSession).stages) == stages
        plain = models[detector].transform(once).select(
            *D.FLOW_ROW_KEY, F.col(detector).alias("plain"), vector_to_array(f"_{detector}_prob").alias("chances"))
        gap = F.array_max(F.zip_with("chances", f"{detector}_probabilities", lambda x, y: F.abs(x - y)))
        found = said.join(plain, D.FLOW_ROW_KEY).agg(
            F.count("*").alias("n"), F.max(gap).alias("gap"), F.count_if(F.col(detector) != F.col("plain")).alias("other")).first()
        assert found.n > 1000 and found.gap <= near and found.other == 0
    assert models["svm"].stages[3].getOrDefault("size") == TINY.fourier_size  # saved models stay as they were


def test_scoring_trees_and_networks_agrees_with_training(split, models):
    import numpy as np

    from flowsentry.ml.boosting import Trees
    from flowsentry.ml.network import Network, autoencoder_layers, convolution_layers

    random = np.random.default_rng(3)
    x = random.normal(size=(200, 9))
    for layers in (convolution_layers(9, 4), autoencoder_layers(9), [["conv", 2], ["relu"], ["pool"], ["flat"], ["dense", 3]]):
        network = Network(layers, 9)
        weights, moments = network.start(1)
        moments = np.abs(moments + random.normal(size=len(moments)))
        for until in (None, 1, 2, 3):
            assert np.allclose(network.output(weights, moments, x, until), network.forward(weights, moments, x, until=until)[0])
    edges = [np.sort(random.normal(size=7)) for _ in range(9)]
    asked = [np.where((np.arange(16) > 0) & (np.arange(16) < 8) & (random.random((3, 16)) < 0.8), random.integers(0, 9, (3, 16)), -1) for _ in range(5)]
    trees = Trees(edges, 3, asked, [random.integers(0, 7, (3, 16)) for _ in range(5)], [random.normal(size=(3, 16)) for _ in range(5)])
    want = np.zeros((200, 3))
    for turn in range(5):
        want += trees.added(trees.binned(x), turn)
    assert np.array_equal(trees.scores(x), want)


def test_bounded_samples_are_drawn_by_all_tasks(spark):
    from flowsentry.operators.profile import gathered

    rows = spark.range(0, 160, 1, 16).withColumn("task", F.spark_partition_id())
    found = gathered(rows, 4)
    assert found.rdd.getNumPartitions() == 4 and found.select("task").distinct().count() == 16 and found.count() == 160


def test_grid_reads_a_fold_once_with_the_same_results(split, monkeypatch):
    from flowsentry.ml import tuning as MT

    train = split.filter("split = 'train'").select(*D.FLOW_ROW_KEY, *FLOW_FEATURES, FLOW_LABEL)
    grid = {"numTrees": [2, 3], "maxDepth": [4, 25, 30]}
    walked = MT.grid_search(train, grid, folds=2, key=D.FLOW_ROW_KEY, fit_rows=300)[0].collect()
    monkeypatch.setattr(MT, "walk_of", lambda spark, model: None)
    assert walked == MT.grid_search(train, grid, folds=2, key=D.FLOW_ROW_KEY, fit_rows=300)[0].collect()


def flow_rows(spark, rows):
    """Feature rows with a key and two classes."""
    return spark.range(rows).select("id", *[((F.col("id") * (i + 3)) % 101).cast("double").alias(c) for i, c in enumerate(FLOW_FEATURES)],
                                    F.when(F.col("id") % 5 == 0, "DoS").otherwise("Normal").alias(FLOW_LABEL))


def test_detectors_are_fitted_on_all_training_rows(spark, monkeypatch):
    from flowsentry.plans import detection

    fitted = {}
    monkeypatch.setattr(detection, "fit_detector", lambda df, detector, settings: fitted.update({detector: df.count()}))
    split = flow_rows(spark, 7_000).withColumn("split", F.when(F.col("id") < 6_500, "train").otherwise("test"))
    train_detectors(split)
    assert fitted == dict.fromkeys(DETECTORS, 6_500)


def test_cross_validation_fits_on_all_rows_of_the_other_folds(spark, monkeypatch):
    from flowsentry.ml import tuning as MT

    fitted, fit_ = [], MT.fit_detector
    monkeypatch.setattr(MT, "fit_detector", lambda df, detector, settings, *a: fitted.append(df.count()) or fit_(df, detector, TINY, *a))
    MT.cross_validated_f1(flow_rows(spark, 12_000).withColumn("fold", (F.col("id") % 2).cast("int")), 2, Settings(), key=["id"])
    assert fitted == [6_000, 6_000]


def test_the_grid_fits_on_all_rows_of_the_other_folds(spark, monkeypatch):
    from flowsentry.ml import tuning as MT
    from flowsentry.plans.registry import QUERIES

    fitted, fit_ = [], MT.RandomForestClassifier.fit
    monkeypatch.setattr(MT, "GRID", {"numTrees": [2, 3]})
    monkeypatch.setattr(MT.RandomForestClassifier, "fit", lambda self, df, combo: fitted.append(df.count()) or fit_(self, df, combo))
    QUERIES["rf_grid"](spark, FOLDER).collect()
    train = training_frame(D.flows(table(spark, FOLDER, "lineitem")), D.FLOW_ROW_KEY).filter("split = 'train'").count()
    assert len(fitted) == 6 and sum(fitted) == 4 * train and min(fitted) > 2_000


def test_large_forests_are_judged_apart_with_the_same_results(split, monkeypatch):
    from flowsentry.ml import tuning as MT

    train = split.filter("split = 'train'").select(*D.FLOW_ROW_KEY, *FLOW_FEATURES, FLOW_LABEL)
    grid, held = {"numTrees": [2, 3]}, []
    found = MT.grid_search(train, grid, folds=2, key=D.FLOW_ROW_KEY)[0].collect()
    monkeypatch.setattr(MT, "SIDE_BY_SIDE", 0)
    monkeypatch.setattr(MT, "NODES", 50)
    metrics_ = MT._metrics
    monkeypatch.setattr(MT, "_metrics", lambda rows, forests, judge: held.append(len(forests)) or metrics_(rows, forests, judge))
    assert found == MT.grid_search(train, grid, folds=2, key=D.FLOW_ROW_KEY)[0].collect()
    assert held == [1] * 4


def test_kernel_machines_are_as_good_as_those_on_stored_features(spark):
    import numpy as np
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import vector_to_array

    from flowsentry.ml.fourier import RandomFourierFeatures
    from flowsentry.ml.machines import fit_machines, machine

    random = np.random.default_rng(5)
    x = random.normal(size=(300, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * random.normal(size=300) > 0).astype(float)
    rows = VectorAssembler(inputCols=list("abc"), outputCol="v").transform(
        spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double"))
    lifted = RandomFourierFeatures("v", "k", 16).drawn(3)
    weights, heights = fit_machines(rows, "y", "v", lifted, 2, 60)
    kernels = lifted.transform(rows).persist()
    data = [(np.array(r.k), r.y) for r in kernels.select(vector_to_array("k").alias("k"), "y").collect()]
    k, side = np.stack([d[0] for d in data]), np.array([d[1] for d in data])
    for i in range(2):
        own = kernels.withColumn("own", (F.col("y") == i).cast("double"))
        theirs = LinearSVC(labelCol="own", featuresCol="k", maxIter=60).fit(own)
        loss = [np.maximum(0, 1 - np.where(side == i, 1, -1) * (k @ w + h)).mean()
                for w, h in ((weights[:, i], heights[i]), (theirs.coefficients.toArray(), theirs.intercept))]
        assert loss[0] < 1.05 * loss[1]
        says = machine(spark, weights[:, i], heights[i], "k", "says", "m").transform(own).select("says", vector_to_array("m").alias("m")).collect()
        assert [r.m[1] for r in says] == pytest.approx((k @ weights[:, i] + heights[i]).tolist())
        assert [r.says for r in says] == [float(r.m[1] > 0) for r in says]
    kernels.unpersist()
