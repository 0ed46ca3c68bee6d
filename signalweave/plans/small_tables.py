"""Queries of operators on events, channels and metadata, and SQL for series operators that are sums over pairs of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Recording
from ..operators import artifacts, connectivity, epochs, filters, missing, select, sequence, spectral, stats, views
from ..operators import events as ev
from . import workflows
from .registry import _POS, _VAR, _W, CROSS, FREQ, ORACLES, RATE, SEG, TWO, A, C, E, G, M, load, markers, on_a, on_b, positions, query, r, view_a, view_gaps


# ---------------------------------------------------------------- events
@query("SELECT round((25 - n_nationkey) * 0.25, 6) + 0.0 AS onset, 0.5::DOUBLE AS duration, n_name AS type, 'v' AS value FROM nation")
def events_make(spark, sf):
    rows = load(spark, sf, "nation").select("n_nationkey", "n_name").collect()
    return ev.make_events(spark, [(25 - k) * 0.25 for k, _ in rows], 0.5, [n for _, n in rows], "v")


@query(f"WITH {M} SELECT {r('onset', 'onset')}, type, value FROM m WHERE type = 'stimulus'")
def events_get(spark, sf):
    return ev.get_events(markers(spark, sf), "stimulus").select("onset", "type", "value")


@query(f"WITH {M} SELECT {r('onset', 'onset')}, 0.0::DOUBLE AS duration, 'event' AS type, '' AS value FROM m")
def events_defaults(spark, sf):
    return ev.with_defaults(markers(spark, sf).select("onset"))


@query(f"WITH {M} SELECT count(*) AS n FROM m")
def events_count(spark, sf):
    return spark.createDataFrame([(ev.count_events(markers(spark, sf)),)], "n long")


# ---------------------------------------------------------------- selection and metadata
on_a(f"WITH {A} SELECT channel, sample - 10 AS sample, {r('value', 'value')} FROM a WHERE sample BETWEEN 11 AND 60 AND channel IN ('view', 'click')", "subset_range", lambda a: select.subset(a, (11, 60), ["view", "click"]))
on_a(f"WITH {A} SELECT channel, CASE sample WHEN 3 THEN 1 WHEN 5 THEN 2 ELSE 3 END::BIGINT AS sample, {r('value', 'value')} FROM a WHERE sample IN (3, 5, 9)", "subset_list", lambda a: select.subset(a, [9, 3, 5]))
on_a(f"WITH {A} SELECT channel, sample, {r('(sample - 1) / 100.0', 'time')} FROM a", "time_index", lambda a: a.select("channel", "sample", select.time_of(F.col("sample"), RATE).alias("time")))


@query(f"WITH {M} SELECT {r('onset', 'onset')}, CAST(round_even(onset * 100.0, 0) AS BIGINT) + 1 AS sample, {r('CAST(round_even(onset * 100.0, 0) AS BIGINT) / 100.0', 'seconds')} FROM m")
def seconds_to_samples(spark, sf):
    at = markers(spark, sf).select("onset", select.sample_of(F.col("onset"), RATE).alias("sample"))
    return at.withColumn("seconds", select.time_of(F.col("sample"), RATE))


def nations(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as channels: every third has no label, the type follows the region."""
    name, none = F.col("n_name"), F.lit(None).cast("string")
    kind = F.when(F.col("n_regionkey") == 0, "EEG").when(F.col("n_regionkey") == 1, "EMG").otherwise("EOG")
    return load(spark, sf, "nation").select(name.alias("channel"), F.when(F.col("n_nationkey") % 3 != 0, name).alias("label"), kind.alias("type"), F.lit("uV").alias("unit"), none.alias("reference"), none.alias("status"), *[F.lit(None).cast("double").alias(f"pos_{p}") for p in "xyz"])


NATIONS = "ch AS (SELECT n_name AS channel, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS label, CASE n_regionkey WHEN 0 THEN 'EEG' WHEN 1 THEN 'EMG' ELSE 'EOG' END AS type FROM nation)"


@query(f"WITH {NATIONS} SELECT channel, type FROM ch WHERE type IN ('EEG', 'EMG')")
def channels_by_type(spark, sf):
    return select.channels_by_type(nations(spark, sf), "EEG", "EMG").select("channel", "type")


@query(f"WITH {NATIONS} SELECT channel, coalesce(label, 'Ch' || row_number() OVER (ORDER BY channel)) AS label FROM ch")
def channel_labels(spark, sf):
    return select.channel_labels(nations(spark, sf)).select("channel", "label")


@query(f"WITH {NATIONS} SELECT channel, CASE label WHEN 'KENYA' THEN 'mV' WHEN 'PERU' THEN 'nV' ELSE 'uV' END AS unit FROM ch")
def channel_units(spark, sf):
    return select.set_channel_field(nations(spark, sf), "unit", {"KENYA": "mV", "PERU": "nV"}).select("channel", "unit")


@query("SELECT n_name AS channel, CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey < 10 THEN n_nationkey * 0.5::DOUBLE END AS pos_x, CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey < 10 THEN 1.0::DOUBLE END AS pos_y FROM nation")
def channel_positions(spark, sf):
    at = load(spark, sf, "nation").filter("n_nationkey < 10").select(F.col("n_name").alias("label"), (F.col("n_nationkey") * 0.5).alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z"))
    return select.set_positions(nations(spark, sf), at).select("channel", "pos_x", "pos_y")


_SITES = ["Fp1", "fp2", "CZ", "Oz", "X9"]
_KNOWN = ", ".join(f"({k!r}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for k, (x, y, z) in select.MONTAGE.items())


@query(f"SELECT c.label, pos_x, pos_y, pos_z FROM (VALUES {', '.join(f'({s!r})' for s in _SITES)}) c(label) LEFT JOIN (VALUES {_KNOWN}) p(k, pos_x, pos_y, pos_z) ON upper(c.label) = k")
def montage(spark, sf):
    return select.apply_montage(select.channel_table(spark, [(s, s) for s in _SITES])).select("label", "pos_x", "pos_y", "pos_z")


on_a(f"WITH {A} SELECT channel, (sample - 1) // 2 + 1 AS sample, {r('value', 'value')} FROM a WHERE sample % 2 = 1", "assay_added", lambda a: Recording(a, RATE).add_assay("slow", sequence.stride(a, 2), 50.0).assay("slow"))


@query("SELECT * FROM (VALUES ('raw', 100.0::DOUBLE), ('slow', 50.0)) t(assay, rate)")
def assay_rates(spark, sf):
    a = view_a(spark, sf)
    return spark.createDataFrame(list(Recording(a, RATE).add_assay("slow", sequence.stride(a, 2), 50.0).assay_rates().items()), "assay string, rate double")


@query("SELECT * FROM (VALUES (1::BIGINT, NULL, false, NULL), (2, 'average', true, NULL), (3, 'view+click', false, 'average')) t(step, reference, is_average, previous)")
def reference_state(spark, sf):
    first = Recording(view_a(spark, sf), RATE)
    second = filters.rereference_recording(first)
    third = filters.rereference_recording(second, "channels", ["view", "click"])
    rows = [(k, filters.current_reference(x), filters.is_average_referenced(x), x.metadata.get("previous_reference")) for k, x in enumerate((first, second, third), 1)]
    return spark.createDataFrame(rows, "step long, reference string, is_average boolean, previous string")


on_a(f"WITH {A} SELECT channel, sample, {r('value - avg(CASE WHEN channel = ' + chr(39) + 'view' + chr(39) + ' THEN value END) OVER (PARTITION BY sample)', 'value')} FROM a QUALIFY channel <> 'view'", "reref_dropped", lambda a: filters.rereference_recording(Recording(a, RATE), "channel", ["view"], keep=False).signals)
on_a(ORACLES["na_locf"], "na_replace", lambda a: missing.replace(a, "locf"), view_gaps)


# ---------------------------------------------------------------- epochs, cleaning
@query(f"WITH {E} SELECT DISTINCT sample, {r('(sample - 21) / 100.0', 'time')} FROM e")
def epoch_time_axis(spark, sf):
    return epochs.extract(view_a(spark, sf), markers(spark, sf), RATE, -0.2, 0.3).select("sample", epochs.epoch_time(RATE, -0.2).alias("time")).distinct()


@query(
    f"WITH {A}, {M}, n AS (SELECT max(sample) AS n FROM a), k AS (SELECT p.*, row_number() OVER (ORDER BY onset, type, value) AS epoch FROM (SELECT *, CAST(floor(onset * 100.0) AS BIGINT) AS pt FROM m) p, n WHERE pt - 20 >= 0 AND pt + 30 <= n.n) "
    f"SELECT a.channel, epoch, a.sample - (pt - 20) AS sample, {r('a.value', 'value')} FROM k JOIN a ON a.sample BETWEEN pt - 19 AND pt + 30"
)
def epoch_floor(spark, sf):
    return epochs.extract_floor(view_a(spark, sf), markers(spark, sf), RATE, -0.2, 0.3)


_BAD = _VAR + ", q AS (SELECT 1.4826::DOUBLE * median(abs(v - m)) AS mad, any_value(m) AS m FROM v, m), bad AS (SELECT channel FROM v, q WHERE abs(v - m) / (mad + 1e-10) > 1), g AS (SELECT * FROM a WHERE channel NOT IN (SELECT channel FROM bad))"
on_a(_BAD + f" SELECT channel, sample, {r('value', 'value')} FROM g UNION ALL SELECT bad.channel, sample, {r('avg(value)', 'value')} FROM g, bad GROUP BY bad.channel, sample", "clean_bad_channels", lambda a: artifacts.clean_recording(Recording(a, RATE), ("bad_channels",), 1.0).signals)

# ---------------------------------------------------------------- spectra, connectivity, statistics, views
on_a(f"WITH {A}, d AS (SELECT channel, sample, value, coalesce((lead(value) {_W}) - lag(value) {_W})) / 2, 0) AS im FROM a) SELECT channel, sample, {r('sqrt(value * value + im * im)', 'value')} FROM d", "derivative_amplitude", lambda a: spectral.amplitude(spectral.derivative_pair(a)))
on_a(CROSS + f", h AS (SELECT c.a, c.b, (c.re * c.re + c.im * c.im) / (x.re * y.re) AS value FROM c JOIN c x ON x.a = c.a AND x.b = c.a AND x.k = c.k JOIN c y ON y.a = c.b AND y.b = c.b AND y.k = c.k WHERE c.a < c.b) SELECT a, b, {r('avg(value)', 'value')} FROM h GROUP BY a, b", "connectivity_coherence", lambda a: connectivity.connectivity(a, "coherence", RATE, size=64))
on_a(f"WITH {C} SELECT a, b, {r('value', 'value')} FROM c UNION ALL SELECT b, a, {r('value', 'value')} FROM c UNION ALL SELECT DISTINCT channel, channel, 1.0::DOUBLE FROM a", "corr_matrix", lambda a: connectivity.full_matrix(connectivity.connectivity(a, "correlation")))
_T = TWO + ", t AS (SELECT sample, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t FROM s)"
_ERF = "1 - (((((1.061405429::DOUBLE * u - 1.453152027) * u) + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u * exp(-x * x)"
on_b(_T + f", x AS (SELECT sample, t, abs(t) / sqrt(2) AS x FROM t), u AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS u FROM x) SELECT sample, {r('t', 't')}, {r(f'2 * (1 - 0.5::DOUBLE * (1 + ({_ERF})))', 'p')} FROM u", "ttest_normal_p", lambda b: stats.with_normal_p(stats.t_test(b, 0, 1)).drop("df"))
on_b(_T + f", h AS (SELECT *, sample - row_number() OVER (ORDER BY sample) AS g FROM t WHERE abs(t) > 2) SELECT min(sample) AS start, max(sample) AS \"end\", {r('sum(t)', 'stat')} FROM h GROUP BY g", "threshold_runs", lambda b: stats.threshold_runs(stats.t_test(b, 0, 1)))
on_b(_T + f" SELECT sample, {r('t', 't')}, {r('100.0::DOUBLE * (sample - 1) / 63', 'percent')} FROM t", "percent_axis", lambda b: views.percent_axis(stats.t_test(b, 0, 1)).drop("df"))
on_a(f"WITH {A} SELECT {r('(sample - 1) / 100.0', 'time')}, {r('value', 'amplitude')} FROM a WHERE channel = 'view'", "trace", lambda a: views.trace(a, RATE, "view"))


@query(
    f"WITH {A}, {_POS}, v AS (SELECT channel, (sample - 1) / 100.0::DOUBLE AS time, value FROM a WHERE sample IN (11, 21)), g AS (SELECT -1.0::DOUBLE + i * (2.0::DOUBLE / 7) AS x, -1.0::DOUBLE + j * (2.0::DOUBLE / 7) AS y FROM generate_series(0, 7) p(i), generate_series(0, 7) q(j)), "
    "d AS (SELECT x, y, time, value, greatest(sqrt((x - px) ** 2 + (y - py) ** 2), 1e-12) AS d FROM g, v JOIN ps USING (channel) WHERE x * x + y * y <= 1.0) "
    f"SELECT {r('x', 'x')}, {r('y', 'y')}, {r('CASE WHEN min(d) < 1e-10 THEN arg_min(value, d) ELSE sum(value * d ** -2) / sum(d ** -2) END', 'value')}, {r('time', 'time')} FROM d GROUP BY x, y, time"
)
def topomap_series(spark, sf):
    return views.topomap_series(view_a(spark, sf), positions(spark), RATE, [0.1, 0.2], resolution=8)


# ---------------------------------------------------------------- SQL for registered series operators
_DFT = f"WITH {A}, k AS (SELECT channel, sample - 1 AS k, count(*) OVER (PARTITION BY channel) AS n FROM a), f AS (SELECT channel, k, any_value(n) AS n, sum(value * cos(2 * pi() * ((k * (sample - 1)) % n) / n)) AS re, sum(value * sin(2 * pi() * ((k * (sample - 1)) % n) / n)) AS im FROM a JOIN k USING (channel) GROUP BY channel, k) "
ORACLES["fft_magnitude"] = _DFT + f"SELECT channel, k + 1 AS sample, {r('sqrt(re * re + im * im)', 'value')} FROM f"
ORACLES["periodogram"] = _DFT + f"SELECT channel, {r('k * 100.0 / n', 'frequency')}, {r('(re * re + im * im) / n', 'power')} FROM f WHERE k < n // 2"
ORACLES["psd_first_window"] = SEG + f"SELECT channel, {r('k * 100.0 / 64', 'frequency')}, {r('10 * log10((re * re + im * im) / 64 + 1e-10)', 'power')} FROM f WHERE s = 0 AND k < 32"
ORACLES["upsample"] = ORACLES["resample_linear"].replace("* 40.0", "* 200.0")
ORACLES["to_percent"] = (
    f"WITH {A}, w AS (SELECT *, lead(value) {_W}) AS nx, max(sample) OVER (PARTITION BY channel) AS n FROM a), p AS (SELECT channel, k, k * ((n - 1) / 100.0::DOUBLE) AS pos, n FROM (SELECT DISTINCT channel, n FROM w), generate_series(0, 100) g(k)), "
    f"q AS (SELECT channel, k, pos, least(n, CAST(floor(pos + 1e-9) AS BIGINT) + 1) AS sample FROM p) SELECT channel, k + 1 AS sample, {r('value + coalesce((pos - (sample - 1)) * (nx - value), 0)', 'value')} FROM q JOIN w USING (channel, sample)"
)
ORACLES["corr_kendall"] = f"WITH {C}, z AS (SELECT i.a, i.b, sign(i.x - j.x) AS p, sign(i.y - j.y) AS q FROM pr i JOIN pr j ON i.a = j.a AND i.b = j.b AND i.sample < j.sample) SELECT a, b, {r('sum(p * q) / (sqrt(sum(abs(p))::DOUBLE) * sqrt(sum(abs(q))::DOUBLE))', 'value')} FROM z GROUP BY a, b"
ORACLES["peaks_min_distance"] = (
    f"WITH RECURSIVE {A}, s AS (SELECT *, lag(value) {_W}) AS p, lead(value) {_W}) AS q FROM a), k AS (SELECT channel, sample, value FROM s WHERE value > p AND value > q AND value > 50), "
    "nx AS (SELECT i.channel, i.sample, min(j.sample) AS following FROM k i JOIN k j ON i.channel = j.channel AND j.sample >= i.sample + 5 GROUP BY i.channel, i.sample), "
    f"g(channel, sample) AS (SELECT channel, min(sample) FROM k GROUP BY channel UNION ALL SELECT nx.channel, nx.following FROM g JOIN nx ON nx.channel = g.channel AND nx.sample = g.sample) SELECT channel, sample, {r('value', 'value')} FROM g JOIN k USING (channel, sample)"
)
_SPIKES = f"WITH {A}, e AS (SELECT channel, sample, coalesce(value * value - lag(value) {_W}) * lead(value) {_W}), 0) AS v FROM a), z AS (SELECT *, max(v) OVER (PARTITION BY channel) AS top, lag(v) {_W}) AS p, lead(v) {_W}) AS q FROM e), k AS (SELECT channel, sample FROM z WHERE v > 0.3 * top AND v > p AND v > q) "
ORACLES["firing"] = _SPIKES + f", d AS (SELECT channel, sample - lag(sample) {_W}) AS gap FROM k), c AS (SELECT channel, count(*) AS n_spikes, stddev_samp(gap) / avg(gap) AS cv FROM d GROUP BY channel), n AS (SELECT channel, max(sample) AS n FROM a GROUP BY channel) SELECT channel, coalesce(n_spikes, 0) AS n_spikes, {r('coalesce(n_spikes, 0) * 100.0 / n', 'firing_rate')}, {r('cv', 'interval_cv')} FROM n LEFT JOIN c USING (channel)"
ORACLES["spike_average"] = _SPIKES + f"SELECT a.channel, a.sample - k.sample AS \"offset\", {r('avg(value)', 'value')} FROM k JOIN a ON a.channel = k.channel AND a.sample BETWEEN k.sample - 5 AND k.sample + 5 GROUP BY a.channel, a.sample - k.sample"
ORACLES["emg_features"] = FREQ + f", tf AS ({ORACLES['emg_time_features']}), sf AS (SELECT channel, {r('avg(mnf)', 'mnf')}, {r('avg(mdf)', 'mdf')}, {r('avg(pkf)', 'pkf')} FROM e GROUP BY channel) SELECT * FROM tf LEFT JOIN sf USING (channel)"
# the imaginary part is a circular convolution with a closed kernel
_HILBERT = (
    f"WITH {A}, n AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM a), p AS (SELECT x.channel, x.sample, x.value AS re, x.sample - y.sample AS m, x.n, y.value AS y FROM n x JOIN n y USING (channel)), "
    "z AS (SELECT channel, sample, any_value(re) AS re, sum(CASE WHEN m = 0 THEN 0 WHEN n % 2 = 0 THEN CASE WHEN m % 2 = 0 THEN 0 ELSE y * 2 / n / tan(pi() * m / n) END ELSE y / n * (cos(pi() * m / n) - CASE WHEN m % 2 = 0 THEN 1 ELSE -1 END) / sin(pi() * m / n) END) AS im FROM p GROUP BY channel, sample) "
)
ORACLES["hilbert"] = _HILBERT + f"SELECT channel, sample, {r('re', 're')}, {r('im', 'im')} FROM z"
ORACLES["hilbert_amplitude"] = _HILBERT + f"SELECT channel, sample, {r('sqrt(re * re + im * im)', 'value')} FROM z"
ORACLES["hilbert_phase"] = _HILBERT + f"SELECT channel, sample, {r('atan2(im, re)', 'value')} FROM z"


def _taps(order: int, edge: float) -> str:
    """SQL of the taps of a Hamming-windowed low pass: h (m, w), with the edge as a share of Nyquist."""
    return f"h0 AS (SELECT m, CASE WHEN m = 0 THEN {edge}::DOUBLE ELSE sin(pi() * {edge}::DOUBLE * m) / (pi() * m) END * (0.54::DOUBLE + 0.46::DOUBLE * cos(2 * pi() * m / {order}.0)) AS w FROM generate_series(-{order // 2}, {order // 2}) g(m)), h AS (SELECT m, w / (SELECT sum(w) FROM h0) AS w FROM h0)"


ORACLES["sinc_low"] = f"WITH {A}, {_taps(100, 0.4)} SELECT o.channel, o.sample, {r('sum(h.w * a.value)', 'value')} FROM a o JOIN a ON a.channel = o.channel AND a.sample BETWEEN o.sample - 50 AND o.sample + 50 JOIN h ON h.m = o.sample - a.sample GROUP BY o.channel, o.sample"
ORACLES["fir_low"] = (
    f"WITH {A}, {_taps(50, 0.4)}, b AS (SELECT x.m + y.m AS m, sum(x.w * y.w) AS w FROM h x, h y GROUP BY x.m + y.m), n AS (SELECT channel, max(sample) AS n, arg_min(value, sample) AS first, arg_max(value, sample) AS last FROM a GROUP BY channel), "
    "x AS (SELECT channel, sample, value FROM a UNION ALL SELECT channel, 2 - sample, 2 * first - value FROM a JOIN n USING (channel) WHERE sample BETWEEN 2 AND 51 UNION ALL SELECT channel, 2 * n - sample, 2 * last - value FROM a JOIN n USING (channel) WHERE sample BETWEEN n - 50 AND n - 1) "
    f"SELECT o.channel, o.sample, {r('sum(b.w * x.value)', 'value')} FROM a o JOIN x ON x.channel = o.channel AND x.sample BETWEEN o.sample - 50 AND o.sample + 50 JOIN b ON b.m = o.sample - x.sample GROUP BY o.channel, o.sample"
)
_MORLET = (
    "fr(f) AS (VALUES (5.0::DOUBLE), (10.0), (20.0)), sg AS (SELECT f, 7 / (2 * pi() * f) AS s, CAST(ceil(6 * 7 / (2 * pi() * f) * 100) AS BIGINT) AS half FROM fr), k0 AS (SELECT f, m, exp(-((m / 100.0::DOUBLE) ** 2) / (2 * s * s)) AS g FROM sg, generate_series(-half, half) t(m)), "
    "l2 AS (SELECT f, sqrt(sum(g * g)) AS l FROM k0 GROUP BY f), k AS (SELECT f, m, g / l * cos(2 * pi() * f * m / 100) AS re, g / l * sin(2 * pi() * f * m / 100) AS im FROM k0 JOIN l2 USING (f)), "
    "z AS (SELECT o.channel, o.sample, k.f, sum(k.re * a.value) AS re, sum(k.im * a.value) AS im FROM a o JOIN a ON a.channel = o.channel AND a.sample BETWEEN o.sample - 140 AND o.sample + 140 JOIN k ON k.m = o.sample - a.sample GROUP BY o.channel, o.sample, k.f)"
)
ORACLES["wavelet"] = f"WITH {A}, {_MORLET} SELECT channel, sample, f AS frequency, {r('re * re + im * im', 'power')}, {r('atan2(im, re)', 'phase')} FROM z"


# ---------------------------------------------------------------- workflows
@query("SELECT * FROM (VALUES ('eegERP', 7::BIGINT, 4::BIGINT), ('eegConnectivity', 7, 5), ('emgBasic', 8, 5), ('emgFatigue', 8, 6), ('emgSynergy', 9, 8), ('emgGait', 11, 9), ('emgMotorUnit', 7, 5), ('emgPattern', 6, 5), ('emgAnalysis', 7, 4), ('ecgAnalysis', 5, 4), ('gaitAnalysis', 7, 3), ('exploratory', 5, 0)) t(workflow, steps, required)")
def workflow_catalogue(spark, sf):
    return workflows.catalogue(spark).groupBy("workflow").agg(F.count("*").alias("steps"), F.count_if("required").alias("required"))


on_a(ORACLES["firing"].replace("FROM events)", "FROM events)", 1), "workflow_firing", lambda a: workflows.METHODS["firingRate"](workflows.State(Recording(a, RATE))))


@query()
def workflow_erp(spark, sf):
    return workflows.run("eegERP", Recording(view_a(spark, sf), RATE, events=markers(spark, sf)))["erpComputation"]
ORACLES["resample_fft"] = (
    f"WITH {A}, z AS (SELECT channel, count(*) AS n, CAST(round_even(count(*) / 100.0::DOUBLE * 64.0, 0) AS BIGINT) AS size FROM a GROUP BY channel), "
    "f AS (SELECT channel, k, any_value(n) AS n, any_value(size) AS size, sum(value * cos(2 * pi() * ((k * (sample - 1)) % n) / n)) AS re, -sum(value * sin(2 * pi() * ((k * (sample - 1)) % n) / n)) AS im FROM a JOIN z USING (channel), generate_series(0, size // 2) g(k) GROUP BY channel, k) "
    f"SELECT channel, j + 1 AS sample, {r('sum(CASE WHEN k = 0 OR 2 * k = size THEN 1 ELSE 2 END * (re * cos(2 * pi() * ((k * j) % size) / size) - im * sin(2 * pi() * ((k * j) % size) / size))) / any_value(n)', 'value')} FROM f, generate_series(0, size - 1) g(j) GROUP BY channel, j"
)
