"""Named chains of operators with default parameters (row M12).

A workflow is an ordered list of steps; :func:`run` carries a recording through the required ones (and the
optional ones asked for) and returns the table of each step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Recording
from ..operators import connectivity, decomposition, emg, epochs, filters, network, sequence, spectral, stats, views

#: The steps of each workflow as (method, required, parameters), in order.
WORKFLOWS: dict[str, tuple[tuple[str, bool, dict], ...]] = {
    "eegERP": (("bandpass", True, {"low": 0.1, "high": 30}), ("notch", False, {}), ("epochExtraction", True, {"pre": 0.2, "post": 0.8}), ("erpComputation", True, {}), ("ttest", True, {}), ("effectSize", False, {}), ("clusterPermutation", False, {})),
    "eegConnectivity": (("bandpass", True, {"low": 1, "high": 45}), ("spectrogram", False, {}), ("bandpower", True, {}), ("plv", True, {"low": 8, "high": 13}), ("pli", False, {}), ("networkMetrics", True, {}), ("networkVisualization", True, {})),
    "emgBasic": (("emgBandpass", True, {"low": 20, "high": 500}), ("notch", True, {}), ("rectification", True, {}), ("emgEnvelope", True, {"cutoff": 6, "method": "lowpass"}), ("rmsCalculation", True, {"width": 100}), ("mvcNormalization", False, {}), ("onsetDetection", False, {}), ("ttest", False, {})),
    "emgFatigue": (("emgBandpass", True, {"low": 20, "high": 500}), ("notch", True, {}), ("emgSpectrogram", True, {}), ("medianFrequency", True, {}), ("meanFrequency", True, {}), ("fatigueIndex", True, {}), ("spectralCompression", False, {}), ("rmsCalculation", False, {})),
    "emgSynergy": (("emgBandpass", True, {"low": 20, "high": 450}), ("notch", True, {}), ("rectification", True, {}), ("emgEnvelope", True, {"cutoff": 10}), ("mvcNormalization", True, {}), ("cycleNormalization", True, {"points": 101}), ("synergyVAF", True, {"threshold": 90}), ("muscleSynergy", True, {"k": 4}), ("synergySimilarity", False, {})),
    "emgGait": (("emgBandpass", True, {"low": 20, "high": 500}), ("notch", True, {}), ("rectification", True, {}), ("emgEnvelope", True, {"cutoff": 6}), ("mvcNormalization", True, {}), ("cycleNormalization", True, {}), ("onsetDetection", True, {}), ("activationTiming", True, {}), ("coContractionIndex", True, {}), ("muscleSynergy", False, {}), ("symmetryAnalysis", False, {})),
    "emgMotorUnit": (("emgBandpass", True, {"low": 20, "high": 500}), ("notch", True, {}), ("motorUnitDecomposition", True, {}), ("firingRate", True, {}), ("muapMorphology", True, {}), ("correlation", False, {}), ("ttest", False, {})),
    "emgPattern": (("emgBandpass", True, {"low": 20, "high": 500}), ("notch", True, {}), ("emgFeatureExtraction", True, {}), ("pca", False, {"n": 5}), ("emgClassification", True, {}), ("confusionMatrix", True, {})),
    "emgAnalysis": (("bandpass", True, {"low": 20, "high": 450}), ("notch", True, {}), ("epochExtraction", True, {}), ("erpComputation", True, {}), ("bandpower", False, {}), ("correlation", False, {}), ("ttest", False, {})),
    "ecgAnalysis": (("bandpass", True, {"low": 0.5, "high": 40}), ("notch", True, {}), ("psd", True, {}), ("bandpower", True, {}), ("ttest", False, {})),
    "gaitAnalysis": (("bandpass", False, {"low": 0.5, "high": 20}), ("cycleNormalization", True, {}), ("phaseSegmentation", True, {}), ("symmetryAnalysis", True, {}), ("dtw", False, {}), ("pca", False, {}), ("ttest", False, {})),
    "exploratory": (("bandpass", False, {}), ("spectrogram", False, {}), ("psd", False, {}), ("correlation", False, {}), ("pca", False, {})),
}


@dataclass
class State:
    """What the steps so far have made: the signals, the epochs cut from them, and the table of each step."""

    recording: Recording
    epochs: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def signals(self) -> DataFrame:
        return self.recording.signals

    def become(self, signals: DataFrame) -> DataFrame:
        self.recording = self.recording.with_signals(signals)
        return signals


METHODS: dict[str, Callable[..., DataFrame]] = {}


def method(*names: str):
    def add(fn):
        METHODS.update(dict.fromkeys(names, fn))
        return fn

    return add


def _conditions(s: State) -> tuple[DataFrame, list]:
    if s.epochs is None:
        raise ValueError("epochExtraction comes first")
    kinds = sorted(r[0] for r in s.recording.events.select("type").distinct().collect())
    return s.epochs.withColumnRenamed("event_type", "condition"), kinds


def _pair(s: State) -> tuple:
    rows, kinds = _conditions(s)
    return (rows, kinds[0], kinds[1]) if len(kinds) > 1 else (rows, kinds[0], None)


def _network(s: State) -> DataFrame:
    edges = s.tables.get("plv", s.tables.get("pli"))
    return network.adjacency(edges if edges is not None else connectivity.correlation(s.signals))


@method("bandpass", "emgBandpass")
def bandpass(s: State, low: float = 1.0, high: float = 40.0) -> DataFrame:
    """Edges above the Nyquist frequency are held just below it."""
    return s.become(filters.butterworth_filter(s.signals, s.recording.rate(), low, min(high, 0.45 * s.recording.rate())))


METHODS |= {
    "notch": lambda s, frequency=50.0: s.become(filters.notch_filter(s.signals, s.recording.rate(), frequency)),
    "zscore": lambda s: s.become(sequence.zscore(s.signals)),
    "rectification": lambda s: s.become(emg.rectify(s.signals)),
    "emgEnvelope": lambda s, cutoff=6.0, method="lowpass": s.become(emg.envelope(s.signals, s.recording.rate(), cutoff, method)),
    "rmsCalculation": lambda s, width=100: sequence.moving_rms(s.signals, width),
    "mvcNormalization": lambda s, width=50: s.become(emg.normalize(s.signals, width)),
    "cycleNormalization": lambda s, points=101: s.become(emg.to_percent(s.signals, points)),
    "onsetDetection": lambda s, **o: emg.bursts(s.signals, s.recording.rate(), **o),
    "activationTiming": lambda s, **o: emg.activation_timing(s.signals, s.recording.rate(), **o),
    "spectrogram": lambda s, size=256: spectral.spectrogram(s.signals, s.recording.rate(), size),
    "emgSpectrogram": lambda s, size=256: spectral.spectrogram(s.signals, s.recording.rate(), size),
    "wavelet": lambda s, frequencies=(5.0, 10.0, 20.0): spectral.wavelet(s.signals, s.recording.rate(), list(frequencies)),
    "psd": lambda s, size=256: spectral.welch(s.signals, s.recording.rate(), size),
    "bandpower": lambda s, relative=True: spectral.band_power(s.signals, s.recording.rate(), relative=relative),
    "plv": lambda s, low=8.0, high=13.0: connectivity.plv(s.signals, s.recording.rate(), (low, high)),
    "pli": lambda s, low=8.0, high=13.0: connectivity.pli(s.signals, s.recording.rate(), (low, high)),
    "coherence": lambda s, size=256: connectivity.coherence(s.signals, s.recording.rate(), size),
    "correlation": lambda s: connectivity.correlation(s.signals),
    "networkMetrics": lambda s: network.node_metrics(_network(s)),
    "networkVisualization": lambda s: views.network_view(_network(s), network.degree(_network(s), True), "degree")[0],
    "medianFrequency": lambda s, size=256: emg.spectral_frequencies(s.signals, s.recording.rate(), size).drop("mean_frequency", "peak_frequency"),
    "meanFrequency": lambda s, size=256: emg.spectral_frequencies(s.signals, s.recording.rate(), size).drop("median_frequency", "peak_frequency"),
    "fatigueIndex": lambda s, size=256: emg.fatigue(emg.spectral_frequencies(s.signals, s.recording.rate(), size)),
    "spectralCompression": lambda s, size=256: emg.spectral_compression(emg.spectral_frequencies(s.signals, s.recording.rate(), size)),
    "synergyVAF": lambda s, threshold=90.0, largest=6: decomposition.optimal_synergies(s.signals, largest, threshold),
    "muscleSynergy": lambda s, k=4: decomposition.synergy_table(s.signals, k),
    "synergySimilarity": lambda s: decomposition.synergy_similarity(s.tables["muscleSynergy"], s.tables["muscleSynergy"]),
    "motorUnitDecomposition": lambda s, share=0.3: emg.spikes(s.signals, share),
    "firingRate": lambda s, share=0.3: emg.firing(s.signals, s.recording.rate(), share),
    "muapMorphology": lambda s, seconds=0.005: emg.spike_average(s.signals, s.recording.rate(), seconds),
    "emgFeatureExtraction": lambda s, size=256: emg.features(s.signals, s.recording.rate(), size),
    "pca": lambda s, n=5: decomposition.pca_table(s.signals, n),
    "ttest": lambda s: stats.with_p(stats.t_test(*_pair(s))),
    "anova": lambda s: stats.anova_with_p(stats.anova(_conditions(s)[0])),
    "effectSize": lambda s: stats.effect_size(*_pair(s)),
    "clusterPermutation": lambda s, n=1000: stats.cluster_permutation(*_pair(s), n_permutations=n),
    "phaseSegmentation": lambda s: sequence.segments_between(s.signals, s.recording.events.select(epochs.onset_sample(F.col("onset"), s.recording.rate()).alias("sample"))),
}


@method("epochExtraction")
def extract_epochs(s: State, pre: float = 0.2, post: float = 0.8) -> DataFrame:
    s.epochs = epochs.extract(s.signals, s.recording.events, s.recording.rate(), -pre, post, baseline=(-pre, 0.0) if pre > 0 else None)
    return s.epochs


@method("erpComputation")
def average_epochs(s: State) -> DataFrame:
    rows, _ = _conditions(s)
    return epochs.average(rows, "condition")


@method("coContractionIndex")
def cocontract(s: State, first: str | None = None, second: str | None = None) -> DataFrame:
    """Of two channels, by default the first two by name."""
    names = sorted(r[0] for r in s.signals.select("channel").distinct().collect())
    return emg.cocontraction(s.signals, first or names[0], second or names[1])


@method("dtw")
def warp(s: State) -> DataFrame:
    """Each channel against the first."""
    from ..model import to_vectors

    vectors = to_vectors(s.signals.select("channel", "sample", "value")).withColumnRenamed("channel", "id")
    return emg.warp_distances(vectors, vectors.orderBy("id").limit(1))


def catalogue(spark: SparkSession) -> DataFrame:
    """workflow, place, method, required, available (there is an operator for it), parameters."""
    rows = [(w, i, m, required, m in METHODS, ", ".join(f"{k}={v}" for k, v in params.items())) for w, steps in WORKFLOWS.items() for i, (m, required, params) in enumerate(steps, 1)]
    return spark.createDataFrame(rows, "workflow string, place int, method string, required boolean, available boolean, parameters string")


def run(name: str, recording: Recording, include: tuple[str, ...] = (), **parameters: dict) -> dict[str, DataFrame]:
    """The tables of the required steps of a workflow and of the optional ones in ``include``, by method.

    ``parameters`` has further arguments by method. The reference names some methods that it has no operator for
    (classification, symmetry); these are left out.
    """
    if name not in WORKFLOWS:
        raise ValueError(f"unknown workflow {name!r}; one of {sorted(WORKFLOWS)}")
    state = State(recording)
    for step, required, defaults in WORKFLOWS[name]:
        if (required or step in include) and step in METHODS:
            state.tables[step] = METHODS[step](state, **(defaults | parameters.get(step, {})))
    return state.tables
