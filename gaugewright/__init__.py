"""The engine's operators, by module."""

from gaugewright.operators.classifier import RegimeClassifier, RegimeModel
from gaugewright.operators.lmir import lmir
from gaugewright.operators.patterns import correlation_analysis, detect_features, get_interval, get_stable_pattern
from gaugewright.operators.rare import rare, rare_inputs
from gaugewright.operators.regimes import LogTimeWindow, Params, classify
from gaugewright.operators.scores import features, scores
from gaugewright.operators.tpmr import tpmr
from gaugewright.operators.workflow import ti_workflow

__all__ = ["LogTimeWindow", "Params", "RegimeClassifier", "RegimeModel", "classify", "correlation_analysis", "detect_features", "features", "get_interval", "get_stable_pattern", "lmir", "rare", "rare_inputs", "scores", "ti_workflow", "tpmr"]
