import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from gaugewright.functions import bayes
from gaugewright.operators import regimes
from gaugewright.operators.classifier import RegimeClassifier, RegimeModel
from gaugewright.operators.regimes import Params, Transient
from tests.test_kernels import HUMP, curve

KEYS = ["group_id", "transient_id"]


def flat_then_steep(until):
    t = np.logspace(-2, 3, 150)
    return t, t**0.1, np.where(t < until, 3.0, 3.0 * (t / until) ** 0.364)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, k, *map(float, r), "x") for k, until in enumerate((10, 30, 50)) for r in zip(*flat_then_steep(until))]
    rows += [(1, 9, 1.0, 1.0, 1.0, "single"), (None, 1, 1.0, 1.0, 1.0, "no key"), (1, 1, None, 1.0, None, "no time")]
    return spark.createDataFrame(rows, "group_id int, transient_id int, time double, pressure double, derivative double, _window_length string")


def test_process_passes_through_its_points():
    x = np.random.default_rng(1).random((12, 2))
    y = np.sin(3 * x[:, 0]) + x[:, 1]
    mean, deviation = bayes.Process(x, y).at(x)
    assert np.allclose(mean, y, atol=1e-3) and (deviation < 1e-2).all()
    assert bayes.Process(x, np.ones(12)).at(x)[0] == pytest.approx(np.ones(12))


def test_expected_improvement_equals_sampling():
    mean, deviation = np.array([0.0, 1.0, -0.5, 2.0, 0.2]), np.array([1.0, 0.5, 2.0, 0.0, 0.0])
    drawn = mean + deviation * np.random.default_rng(2).standard_normal((400_000, 5))
    assert bayes.expected_improvement(mean, deviation, 0.3) == pytest.approx(np.maximum(0.3 - drawn, 0).mean(axis=0), abs=5e-3)


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_the_least_value(seed):
    """Nearer than as many uniform points come on the average, and the same again by the same seed."""
    f = lambda x: float((x[0] - 0.7) ** 2 + 2 * (x[1] + 0.2) ** 2 + 0.1 * np.cos(9 * x[0]))
    least = min(f((a, b)) for a in np.linspace(0, 1, 201) for b in np.linspace(-0.5, 0.5, 201))
    x, y = bayes.minimize(f, (0, -0.5), (1, 0.5), 40, seed=seed)
    assert y == f(x) and y - least < 0.003
    assert (bayes.minimize(f, (0, -0.5), (1, 0.5), 40, seed=seed)[0] == x).all()
    assert bayes.minimize(f, (0.3, 0.1), (0.3, 0.1), 5, seed=seed)[0] == pytest.approx([0.3, 0.1])
    with pytest.raises(ValueError):
        bayes.minimize(f, (0, 0), (1, 1), 0)


@pytest.mark.parametrize("until", [10, 20, 50])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_bayes_does_no_worse_than_the_grid(until, seed):
    """By the value searched for. Regimes may differ: of this curve a long window has the least value, but sees less."""
    fit = Transient.fit(Params(), *flat_then_steep(until))
    value = lambda w, f: fit._try(regimes._with(fit.params, window_length=float(w), filter_value=float(f)), -0.5, 0.5)
    least = fit.least_window(regimes._with(fit.params, filter_value=-0.5))
    _, found = bayes.minimize(lambda x: value(*x), (least, -0.5), (1.0, 0.5), regimes.CALLS, seed=seed)
    assert found <= value(*fit._refined(value, least, 1.0, -0.5, 0.5, 4))


@pytest.mark.parametrize(("pieces", "found"), [([(9, 0.0)], {4, 0}), ([(1.2, 0.0), (9, -0.364)], {4, 0, 2}), ([(9, 0.364)], {4, 1})])
@pytest.mark.parametrize("seed", range(3))
def test_bayes_finds_the_regimes_of_designed_transients(pieces, found, seed):
    t, d = curve(*HUMP, *pieces)
    regime, _, p = Transient.fit(Params(), t, t**0.1, d).optimize(search="bayes", seed=seed)
    assert set(regime.tolist()) == found and p.window_length <= 1


def test_search_names_are_checked():
    with pytest.raises(ValueError):
        Transient.fit(Params(), *flat_then_steep(10)).optimize(search="x")


@pytest.mark.parametrize("search", ["grid", "bayes"])
def test_model_detects_as_the_search_did_and_comes_back_from_disk(spark, frame, tmp_path, search):
    estimator = RegimeClassifier(search=search, seed=3, calls=15)
    estimator.save(str(tmp_path / "estimator"))
    estimator = RegimeClassifier.load(str(tmp_path / "estimator"))
    assert estimator.getOrDefault("search") == search and estimator.getOrDefault("calls") == 15
    model = estimator.fit(frame)
    assert model.found.count() == 3
    key = lambda df: df.toPandas().sort_values([*KEYS, "seq"]).reset_index(drop=True)
    got = key(model.transform(frame))
    want = key(regimes.classify(frame, KEYS, optimize=True, search=search, seed=3, calls=15))
    assert len(got) == 1500 and list(got) == list(want) and got["regime"].tolist() == want["regime"].tolist()
    assert np.allclose(got[[*regimes.DISTANCES, "window_length"]], want[[*regimes.DISTANCES, "window_length"]], equal_nan=True)
    model.save(str(tmp_path / "model"))
    model.write().overwrite().save(str(tmp_path / "model"))
    again = RegimeModel.load(str(tmp_path / "model"))
    assert again.uid == model.uid and key(again.transform(frame)).equals(got)


def test_model_of_fixed_parameters_and_unseen_transients(spark, frame, tmp_path):
    fixed = RegimeClassifier(search="none", windowLength=0.6).fit(frame)
    key = lambda df: sorted(map(tuple, df.select(*KEYS, "seq", "regime", "window_length").collect()))
    assert key(fixed.transform(frame)) == key(regimes.classify(frame, KEYS, Params(window_length=0.6)))
    fixed.save(str(tmp_path / "m"))
    assert key(RegimeModel.load(str(tmp_path / "m")).transform(frame)) == key(fixed.transform(frame))
    model = RegimeClassifier(windowLength=0.6).fit(frame.filter("transient_id = 0"))
    windows = {r.transient_id: r.window_length for r in model.transform(frame).select("transient_id", "window_length").distinct().collect()}
    assert windows[1] == windows[2] == 0.6 and set(windows) == {0, 1, 2}
    assert RegimeClassifier().fit(frame.filter("false")).transform(frame.filter("false")).count() == 0


def test_classifier_in_a_pipeline_and_its_checks(spark, frame, tmp_path):
    model = Pipeline(stages=[RegimeClassifier(keyCols=["g", "t"], derivativeCol="d")]).fit(frame.selectExpr("group_id g", "transient_id t", "time", "pressure", "derivative d"))
    model.save(str(tmp_path / "p"))
    out = PipelineModel.load(str(tmp_path / "p")).transform(frame.selectExpr("group_id g", "transient_id t", "time", "pressure", "derivative d"))
    assert out.count() == 1500 and out.columns[:3] == ["g", "t", "seq"]
    for bad in ({"search": "x"}, {"dsw": 4}, {"metric": "x"}):
        with pytest.raises(ValueError):
            RegimeClassifier(**bad).fit(frame)
    with pytest.raises(TypeError):
        RegimeClassifier(seed="x")


@pytest.mark.parametrize("search", regimes.SEARCHES)
@pytest.mark.parametrize("times", [[0.4, 0.5, 1.0, 2.1], [0.1, 0.2]])
def test_search_on_transients_that_end_before_the_filters(spark, search, times):
    """Shorter than a fragment, every place has the same value; or no filter leaves two points."""
    rows = [(1, 1, t, 10.0 + k, 5.0 + k % 2) for k, t in enumerate(times)]
    frame = spark.createDataFrame(rows, "group_id int, transient_id int, time double, pressure double, derivative double")
    model = RegimeClassifier(search=search).fit(frame)
    found = model.found.collect()
    assert len(found) == 1 and -0.5 <= found[0].filter_value <= 0.5 and 0 < found[0].window_length <= 1
    assert model.transform(frame).count() == regimes.POINTS
