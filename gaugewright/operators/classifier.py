"""The regime classifier as a Spark ML estimator: fit searches parameters, the model detects with them.

A fitted model holds a table of one row a transient (its keys, window_length,
filter_value), so it grows with the transients and is saved beside the metadata
as Parquet; it never passes through the driver."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml import param as ml
from pyspark.ml.param import TypeConverters as Of
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.staging import keep
from gaugewright.operators.regimes import CALLS, SEARCHES, Params, classify

DEFAULTS = {
    "keyCols": ["group_id", "transient_id"], "timeCol": "time", "pressureCol": "pressure", "derivativeCol": "derivative",
    "windowLength": 0.5, "windowStep": 0.02, "metric": "euclidean", "filterValue": 0.0, "fragmentWindow": 0.5, "slopeThreshold": 0.7, "dsw": 25, "rsw": 0.15, "bdw": 10, "smooth": False,
    "search": "grid", "adjustFilter": True, "maxWindow": 1.0, "lowFilter": -0.5, "highFilter": 0.5, "deep": False, "calls": CALLS, "seed": 0,
}


class _Settings(ml.Params):
    """Columns, detection parameters (those of regimes.Params) and how they are searched."""

    keyCols = ml.Param(ml.Params._dummy(), "keyCols", "columns that name a transient", Of.toListString)
    timeCol = ml.Param(ml.Params._dummy(), "timeCol", "elapsed time", Of.toString)
    pressureCol = ml.Param(ml.Params._dummy(), "pressureCol", "pressure change", Of.toString)
    derivativeCol = ml.Param(ml.Params._dummy(), "derivativeCol", "pressure derivative", Of.toString)
    windowLength = ml.Param(ml.Params._dummy(), "windowLength", "length of a window in log time", Of.toFloat)
    windowStep = ml.Param(ml.Params._dummy(), "windowStep", "step between windows in log time", Of.toFloat)
    metric = ml.Param(ml.Params._dummy(), "metric", "name of the distance", Of.toString)
    filterValue = ml.Param(ml.Params._dummy(), "filterValue", "log time before which nothing is detected", Of.toFloat)
    fragmentWindow = ml.Param(ml.Params._dummy(), "fragmentWindow", "log time up to which a run is a fragment", Of.toFloat)
    slopeThreshold = ml.Param(ml.Params._dummy(), "slopeThreshold", "slope above which a tail is boundary", Of.toFloat)
    dsw = ml.Param(ml.Params._dummy(), "dsw", "points of the derivative's smoothing window", Of.toInt)
    rsw = ml.Param(ml.Params._dummy(), "rsw", "log time up to which smoothing drops a run", Of.toFloat)
    bdw = ml.Param(ml.Params._dummy(), "bdw", "points of the boundary's window", Of.toInt)
    smooth = ml.Param(ml.Params._dummy(), "smooth", "whether fixed parameters smooth regimes", Of.toBoolean)
    search = ml.Param(ml.Params._dummy(), "search", "none, grid or bayes", Of.toString)
    adjustFilter = ml.Param(ml.Params._dummy(), "adjustFilter", "whether the filter moves back to where its regime begins", Of.toBoolean)
    maxWindow = ml.Param(ml.Params._dummy(), "maxWindow", "longest window that is tried", Of.toFloat)
    lowFilter = ml.Param(ml.Params._dummy(), "lowFilter", "least filter that is tried", Of.toFloat)
    highFilter = ml.Param(ml.Params._dummy(), "highFilter", "greatest filter that is tried", Of.toFloat)
    deep = ml.Param(ml.Params._dummy(), "deep", "whether the search is finer", Of.toBoolean)
    calls = ml.Param(ml.Params._dummy(), "calls", "points that bayes tries", Of.toInt)
    seed = ml.Param(ml.Params._dummy(), "seed", "seed of bayes", Of.toInt)

    def _detection(self) -> Params:
        """The detection parameters, checked."""
        v = self.getOrDefault
        return Params(v("windowLength"), v("windowStep"), v("metric"), v("filterValue"), v("fragmentWindow"), v("slopeThreshold"), v("dsw"), v("rsw"), v("bdw"), v("smooth"))

    def _classify(self, frame: DataFrame, **how: object) -> DataFrame:
        v = self.getOrDefault
        return classify(frame, v("keyCols"), self._detection(), time=v("timeCol"), pressure=v("pressureCol"), derivative=v("derivativeCol"), **how)


class RegimeClassifier(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """fit(frame) searches each transient's window length and filter value: search "grid" or "bayes" (seeded).

    With "none" nothing is searched, and the model detects by the fixed parameters.
    Rows with a null key, time, pressure or derivative take no part; transients of
    fewer than two samples get no parameters; an empty table gives an empty model;
    extra columns are not read."""

    @keyword_only
    def __init__(self, **values: object) -> None:
        super().__init__()
        self._setDefault(**DEFAULTS)
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, **values: object) -> RegimeClassifier:
        return self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RegimeModel:
        v = self.getOrDefault
        if v("search") not in ("none", *SEARCHES):
            raise ValueError(f"search is none or one of {SEARCHES}")
        self._detection()
        found = None
        if v("search") != "none":
            how = {"search": v("search"), "adjust_filter": v("adjustFilter"), "max_window": v("maxWindow"), "low": v("lowFilter"), "high": v("highFilter"), "calls": v("calls"), "seed": v("seed")}
            points = self._classify(dataset, optimize=True, deep=v("deep"), **how)
            found = keep(points.groupBy(*v("keyCols")).agg(*(F.first(c).alias(c) for c in ("window_length", "filter_value"))), "classifier")
        return self._copyValues(RegimeModel(found))


class RegimeModel(Model, _Settings, MLReadable, MLWritable):
    """transform(frame) gives what regimes.classify gives, each transient by its own parameters.

    `found` holds them; transients it does not name take the fixed parameters. Regimes
    are smoothed where parameters were searched, as at the end of a search, or where `smooth` says so."""

    def __init__(self, found: DataFrame | None = None) -> None:
        super().__init__()
        self._setDefault(**DEFAULTS)
        self.found = found

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._classify(dataset, found=self.found)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: RegimeModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"searched": self.model.found is not None})
        if self.model.found is not None:
            self.model.found.write.parquet(f"{path}/found")


class _Reader(MLReader):
    def __init__(self, cls: type[RegimeModel]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> RegimeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/found") if metadata["searched"] else None)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
