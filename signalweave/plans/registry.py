"""Registered queries over the driver's tables, with SQL where SQL can express them.

View A reads ``events`` as signals: channel = event_type, sample = rank by time, at a nominal
100 Hz. View B reads ``embeddings`` as epochs: epoch = vec_id, condition = label, 64 samples. Markers
come from ``supplier``. Every query runs over whole tables. Results are rounded to six
digits, as sums differ in the last bits between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import artifacts, connectivity, decomposition, emg, epochs, filters, missing, network, select, sequence, spectral, stats, views
from ..operators import events as ev
from ..sources import catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "erp_by_condition"
RATE = 100.0
ALPHA = (8.0, 13.0)


# ---------------------------------------------------------------- views
def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view_a(spark: SparkSession, sf: str) -> DataFrame:
    """channel, sample, value."""
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return load(spark, sf, "events").select(F.col("event_type").alias("channel"), F.row_number().over(order).cast("long").alias("sample"), F.col("value").cast("double").alias("value"))


def view_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """View A with every 17th and 18th value missing."""
    return view_a(spark, sf).withColumn("value", F.when(~(F.col("sample") % 17).isin(0, 1), F.col("value")))


def view_b(spark: SparkSession, sf: str) -> DataFrame:
    """epoch, condition, sample, value."""
    rows = load(spark, sf, "embeddings").select(F.col("vec_id").alias("epoch"), F.col("label").alias("condition"), F.posexplode("embedding").alias("at", "v"))
    return rows.select("epoch", "condition", (F.col("at") + 1).cast("long").alias("sample"), F.col("v").cast("double").alias("value"))


def markers(spark: SparkSession, sf: str) -> DataFrame:
    """onset, duration, type, value."""
    kind = F.when(F.col("s_nationkey") < 13, "stimulus").otherwise("response")
    return load(spark, sf, "supplier").select((0.5 + 0.19 * (F.col("s_suppkey") - 1)).alias("onset"), F.lit(0.0).alias("duration"), kind.alias("type"), F.col("s_nationkey").cast("string").alias("value"))


A = "a AS (SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS sample, CAST(value AS DOUBLE) AS value FROM events)"
G = A.replace("a AS", "a0 AS") + ", a AS (SELECT channel, sample, CASE WHEN sample % 17 > 1 THEN value END AS value FROM a0)"
B = "b AS (SELECT vec_id AS epoch, label AS condition, i AS sample, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, generate_series(1, len(embedding)) t(i))"
M = "m AS (SELECT 0.5::DOUBLE + 0.19::DOUBLE * (s_suppkey - 1) AS onset, 0.0::DOUBLE AS duration, CASE WHEN s_nationkey < 13 THEN 'stimulus' ELSE 'response' END AS type, CAST(s_nationkey AS VARCHAR) AS value FROM supplier)"
#: Epochs of view A around markers, -0.2 to 0.3 s.
E = (
    f"{A}, {M}, n AS (SELECT max(sample) AS n FROM a), "
    "p AS (SELECT *, CAST(round_even(onset * 100.0, 0) AS BIGINT) + 1 AS pt FROM m), "
    "k AS (SELECT p.*, row_number() OVER (ORDER BY onset, type, value) AS epoch FROM p, n WHERE pt - 20 >= 1 AND pt + 30 <= n.n), "
    "e AS (SELECT a.channel, k.epoch, k.type AS event_type, k.value AS event_value, k.onset AS event_onset, a.sample - k.pt + 21 AS sample, a.value FROM k JOIN a ON a.sample BETWEEN k.pt - 20 AND k.pt + 30)"
)


def tidy(df: DataFrame) -> DataFrame:
    """Integers as long, fractions rounded."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf: tidy(fn(spark, sf))
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def on_a(sql: str | None, key: str, fn: Callable[[DataFrame], DataFrame], view=view_a) -> None:
    query(sql, key)(lambda spark, sf: fn(view(spark, sf)))


# ---------------------------------------------------------------- epochs
@query(f"WITH {E} SELECT channel, event_type, sample, {r('avg(value)', 'value')} FROM e GROUP BY channel, event_type, sample")
def erp_by_condition(spark, sf):
    return epochs.average(epochs.extract(view_a(spark, sf), markers(spark, sf), RATE, -0.2, 0.3), "event_type")


@query(f"WITH {E} SELECT channel, epoch, event_type, event_value, {r('event_onset', 'event_onset')}, sample, {r('value', 'value')} FROM e")
def epoch_extract(spark, sf):
    return epochs.extract(view_a(spark, sf), markers(spark, sf), RATE, -0.2, 0.3)


BASE = f"WITH {E}, c AS (SELECT channel, epoch, event_type, sample, value - avg(CASE WHEN sample <= 21 THEN value END) OVER (PARTITION BY channel, epoch) AS value FROM e) "


@query(BASE + f"SELECT channel, epoch, sample, {r('value', 'value')} FROM c")
def epoch_baseline(spark, sf):
    return epochs.extract(view_a(spark, sf), markers(spark, sf), RATE, -0.2, 0.3, baseline=(-0.2, 0.0)).select("channel", "epoch", "sample", "value")


@query(f"WITH {E}, l AS (SELECT channel, epoch, median(CASE WHEN sample <= 21 THEN value END) AS level FROM e GROUP BY ALL) SELECT channel, epoch, sample, {r('value - level', 'value')} FROM e JOIN l USING (channel, epoch)")
def epoch_baseline_median(spark, sf):
    cut = epochs.extract(view_a(spark, sf), markers(spark, sf), RATE, -0.2, 0.3).select("channel", "epoch", "sample", "value")
    return epochs.baseline_correct(cut, RATE, -0.2, (-0.2, 0.0), "median")


@query(f"WITH {E}, q AS (SELECT epoch FROM e GROUP BY epoch HAVING max(abs(value)) <= (SELECT avg(value) + 4 * stddev_samp(value) FROM a)), z AS (SELECT epoch, row_number() OVER (ORDER BY epoch) AS k FROM q) SELECT channel, k AS epoch, sample, {r('value', 'value')} FROM e JOIN z USING (epoch)")
def epoch_reject_amplitude(spark, sf):
    a = view_a(spark, sf)
    limit = a.agg(F.avg("value") + 4 * F.stddev_samp("value")).first()[0]
    return epochs.extract(a, markers(spark, sf), RATE, -0.2, 0.3, reject=limit).select("channel", "epoch", "sample", "value")


for _method, _sql in (
    ("gradient", "max(step)"),
    ("variance", "var_samp(value)"),
):
    query(f"WITH {E}, s AS (SELECT epoch, value, abs(value - lag(value) OVER (PARTITION BY epoch ORDER BY channel, sample)) AS step FROM e) SELECT epoch, {r(_sql, 'score')} FROM s GROUP BY epoch", f"epoch_score_{_method}")(
        lambda spark, sf, m=_method: epochs.epoch_scores(epochs.extract(view_a(spark, sf), markers(spark, sf), RATE, -0.2, 0.3), m)
    )


@query(
    f"WITH {A}, {M}, s AS (SELECT m.*, (SELECT min(x.onset) FROM m x WHERE x.type = 'response' AND x.onset > m.onset) AS end_onset FROM m WHERE type = 'stimulus'), "
    "p AS (SELECT *, CAST(round_even(onset * 100.0, 0) AS BIGINT) + 1 AS pt, CAST(round_even((end_onset - onset) * 100.0, 0) AS BIGINT) AS post FROM s WHERE end_onset IS NOT NULL), "
    "w AS (SELECT *, max(post) OVER () AS longest FROM p), n AS (SELECT max(sample) AS n FROM a), "
    "k AS (SELECT w.*, row_number() OVER (ORDER BY onset, type, value) AS epoch FROM w, n WHERE pt >= 1 AND pt + longest <= n.n) "
    f"SELECT a.channel, k.epoch, a.sample - k.pt + 1 AS sample, {r('a.value', 'value')} FROM k JOIN a ON a.sample BETWEEN k.pt AND k.pt + k.post"
)
def epoch_variable_length(spark, sf):
    return epochs.extract(view_a(spark, sf), markers(spark, sf), RATE, 0.0, "response", event_type="stimulus").select("channel", "epoch", "sample", "value")


@query(
    "WITH t AS (SELECT user_id, event_type AS type, epoch_us(ts) / 1e6 AS onset FROM events) "
    f"SELECT user_id, {r('onset', 'onset')}, {r('end_onset', 'end_onset')} FROM (SELECT s.user_id, s.onset, (SELECT min(x.onset) FROM t x WHERE x.user_id = s.user_id AND x.type = 'purchase' AND x.onset > s.onset) AS end_onset FROM t s WHERE s.type = 'view') WHERE end_onset IS NOT NULL"
)
def paired_events(spark, sf):
    rows = load(spark, sf, "events").select("user_id", F.col("event_type").alias("type"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("onset"))
    return ev.pair_events(rows, "view", "purchase", ["user_id"]).select("user_id", "onset", "end_onset")


SLIDE = f"WITH {A}, w AS (SELECT *, max(sample) OVER (PARTITION BY channel) AS n FROM a), e AS (SELECT channel, CAST(k + 1 AS BIGINT) AS epoch, sample - k * 25 AS sample, value FROM w, generate_series(0, 100000) g(k) WHERE k * 25 <= sample - 1 AND sample - 1 <= k * 25 + 50 AND k * 25 + 51 <= n AND k <= n // 25)"


@query(SLIDE + f" SELECT channel, epoch, sample, {r('value', 'value')} FROM e")
def epoch_sliding(spark, sf):
    return epochs.sliding(view_a(spark, sf), RATE, 0.5)


@query(f"WITH {A} SELECT channel, sample, {r('(value + 2 * value) / 2', 'value')} FROM a")
def grand_average(spark, sf):
    a = view_a(spark, sf)
    return epochs.grand_average(a, a.withColumn("value", 2 * F.col("value")))


@query(f"WITH {B} SELECT sample, {r('avg(value)', 'mean')}, {r('avg(value) - 1.959963984540054 * stddev_samp(value) / sqrt(count(*))', 'low')}, {r('avg(value) + 1.959963984540054 * stddev_samp(value) / sqrt(count(*))', 'high')} FROM b GROUP BY sample")
def average_band(spark, sf):
    return epochs.average_band(view_b(spark, sf))


# ---------------------------------------------------------------- selection, channels, events
on_a(f"WITH {A} SELECT channel, sample - 50 AS sample, {r('value', 'value')} FROM a WHERE sample BETWEEN 51 AND 101", "time_window", lambda a: select.time_window(a, RATE, 0.5, 1.0))
on_a(f"WITH {A}, o(channel, position) AS (VALUES ('view', 1), ('click', 2), ('view', 3)) SELECT channel, CAST(position AS BIGINT) AS position, sample, {r('value', 'value')} FROM a JOIN o USING (channel)", "pick_channels", lambda a: select.pick_channels(a, ["view", "click", "view"]))
on_a(f"WITH {A} SELECT channel, sample, {r('value', 'value')} FROM a WHERE channel <> 'error'", "drop_channels", lambda a: select.drop_channels(a, ["error"]))
on_a(f"WITH {A} SELECT CASE channel WHEN 'view' THEN 'Fz' ELSE channel END AS channel, sample, {r('value', 'value')} FROM a", "rename_channels", lambda a: select.rename_channels(a, {"view": "Fz"}))
on_a(f"WITH {A} SELECT channel, sample, {r('value', 'value')} FROM a UNION ALL SELECT channel || '_2', sample, {r('value', 'value')} FROM a", "bind_channels", lambda a: select.bind_channels(a, a))
on_a(f"WITH {A} SELECT channel, sample, {r('value', 'value')} FROM a UNION ALL SELECT channel, sample + (SELECT max(sample) FROM a), {r('value', 'value')} FROM a", "bind_time", lambda a: select.bind_time(a, a))
on_a(f"WITH {A} SELECT {r('(sample - 1) / 100.0', 'time')}, {', '.join(r(f'max(CASE WHEN channel = {c!r} THEN value END)', c) for c in ('click', 'view'))} FROM a GROUP BY sample", "wide_frame", lambda a: select.wide(a, ["click", "view"], RATE))
on_a(f"WITH {A} SELECT max(sample) AS n_samples, count(DISTINCT channel) AS n_channels FROM a", "shape", select.shape)
on_a(f"WITH {A} SELECT channel, sample, {r('value', 'value')} FROM a WHERE sample BETWEEN 11 AND 150 AND (sample - 11) % 3 = 0", "signal_slice", lambda a: select.signal_slice(a, RATE, 0.1, 1.5, factor=3))


@query(f"WITH {M}, x AS (SELECT * FROM m UNION ALL SELECT 1.234, 0.0, 'extra', 'z') SELECT {r('onset', 'onset')}, {r('duration', 'duration')}, type, value FROM x")
def events_add_sorted(spark, sf):
    return ev.add_events(markers(spark, sf), ev.make_events(spark, [1.234], 0.0, "extra", "z"))


@query(f"WITH {M} SELECT {r('onset', 'onset')}, type, value FROM m WHERE type = 'stimulus' AND value IN ('1', '2', '3')")
def events_filter_type_value(spark, sf):
    return ev.EventQuery(markers(spark, sf)).type("stimulus").value("1", "2", "3").resolve().select("onset", "type", "value")


@query(f"WITH {M}, p AS (SELECT *, row_number() OVER (ORDER BY onset) AS i FROM m) SELECT {r('onset', 'onset')}, type, value FROM p WHERE type <> 'response' AND i NOT IN (1, 3)")
def events_remove(spark, sf):
    return ev.remove_events(markers(spark, sf), ["response"], [1, 3]).select("onset", "type", "value")


# ---------------------------------------------------------------- summaries and missing values
on_a(f"WITH {A} SELECT channel, {r('min(value)', 'min')}, {r('max(value)', 'max')}, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')}, {r('median(value)', 'median')} FROM a GROUP BY channel", "channel_summary", epochs.channel_summary)
on_a(f"WITH {G} SELECT channel, count(*) FILTER (value IS NULL) AS n_na, count(*) AS n_total, {r('100.0 * count(*) FILTER (value IS NULL) / count(*)', 'pct_na')} FROM a GROUP BY channel", "na_summary", missing.summary, view_gaps)
on_a(f"WITH {G} SELECT channel, sample, {r('coalesce(value, 0)', 'value')} FROM a", "na_zero", missing.fill_zero, view_gaps)
on_a(f"WITH {G} SELECT channel, sample, {r('coalesce(value, avg(value) OVER (PARTITION BY channel))', 'value')} FROM a", "na_mean", missing.fill_mean, view_gaps)
_LAST = "last_value(value IGNORE NULLS) OVER (PARTITION BY channel ORDER BY sample)"
_FIRST = "first_value(value IGNORE NULLS) OVER (PARTITION BY channel ORDER BY sample ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
on_a(f"WITH {G} SELECT channel, sample, {r(f'coalesce({_LAST}, {_FIRST})', 'value')} FROM a", "na_locf", missing.fill_last, view_gaps)
on_a(
    f"WITH {G}, s AS (SELECT *, CASE WHEN value IS NOT NULL THEN sample END AS k FROM a), "
    f"t AS (SELECT channel, sample, value, {_LAST} AS lv, {_FIRST} AS hv, {_LAST.replace('(value', '(k')} AS ls, {_FIRST.replace('(value', '(k')} AS hs FROM s) "
    f"SELECT channel, sample, {r('coalesce(value, lv + (hv - lv) / nullif(hs - ls, 0) * (sample - ls), lv, hv)', 'value')} FROM t",
    "na_interpolate", missing.interpolate, view_gaps,
)
on_a(f"WITH {G} SELECT channel, sample, {r(f'CASE WHEN {_LAST} IS NULL OR {_FIRST} IS NULL THEN coalesce({_LAST}, {_FIRST}) ELSE value END', 'value')} FROM a", "na_edge", missing.fill_edges, view_gaps)
on_a(f"WITH {G} SELECT channel, sample, {r('value', 'value')} FROM a WHERE value IS NOT NULL", "na_omit", missing.omit, view_gaps)

# ---------------------------------------------------------------- along samples
_W = "OVER (PARTITION BY channel ORDER BY sample"
on_a(f"WITH {A} SELECT channel, sample, {r(f'CASE WHEN count(*) {_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 THEN avg(value) {_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END', 'value')} FROM a", "moving_average", sequence.moving_average)
on_a(f"WITH {A} SELECT channel, sample, {r('value - avg(value) OVER (PARTITION BY channel)', 'value')} FROM a", "detrend_constant", lambda a: sequence.detrend(a, "constant"))
on_a(f"WITH {A}, f AS (SELECT channel, regr_slope(value, sample) AS s, regr_intercept(value, sample) AS o FROM a GROUP BY channel) SELECT channel, sample, {r('value - (o + s * sample)', 'value')} FROM a JOIN f USING (channel)", "detrend_linear", sequence.detrend)
on_a(f"WITH {A} SELECT channel, sample, {r('(value - avg(value) OVER (PARTITION BY channel)) / coalesce(nullif(stddev_pop(value) OVER (PARTITION BY channel), 0), 1)', 'value')} FROM a", "zscore", sequence.zscore)
on_a(f"WITH {A} SELECT channel, sample, {r(f'coalesce(value * value - lag(value) {_W}) * lead(value) {_W}), 0)', 'value')} FROM a", "tkeo", sequence.teager_kaiser)
on_a(f"WITH {A} SELECT channel, sample, {r(f'sqrt(avg(value * value) {_W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))', 'value')} FROM a", "moving_rms", lambda a: sequence.moving_rms(a, 10))
on_a(f"WITH {A} SELECT channel, sample, {r(f'avg(abs(value)) {_W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)', 'value')} FROM a", "moving_mav", lambda a: sequence.moving_mav(a, 10))
on_a(f"WITH {A} SELECT channel, sample, {r(f'value - lag(value) {_W})', 'value')} FROM a", "gradient", sequence.gradient)
on_a(f"WITH {A}, s AS (SELECT *, lag(value) {_W}) AS p, lead(value) {_W}) AS q FROM a) SELECT channel, sample, {r('value', 'value')} FROM s WHERE value > p AND value > q AND value > 50", "local_peaks", lambda a: sequence.peaks(a, 50.0))
on_a(f"WITH {A}, s AS (SELECT *, lag(value) {_W}) AS p FROM a) SELECT channel, sample, {r('value', 'value')}, p < 50 AS rising FROM s WHERE (p < 50 AND value >= 50) OR (p >= 50 AND value < 50)", "threshold_crossings", lambda a: sequence.crossings(a, 50.0, "both"))
on_a(None, "peaks_min_distance", lambda a: sequence.peaks(a, 50.0, 5))
on_a(f"WITH {A} SELECT channel, (sample - 1) // 4 + 1 AS sample, {r('value', 'value')} FROM a WHERE (sample - 1) % 4 = 0", "decimate_stride", lambda a: sequence.stride(a, 4))


@query(f"WITH {A}, {M}, c AS (SELECT CAST(round_even(onset * 100.0, 0) AS BIGINT) + 1 AS first FROM m), l AS (SELECT first, lead(first) OVER (ORDER BY first) AS last, row_number() OVER (ORDER BY first) AS segment FROM c) SELECT channel, segment, sample, {r('value', 'value')} FROM a JOIN l ON sample BETWEEN first AND last")
def segment_between(spark, sf):
    starts = markers(spark, sf).select(epochs.onset_sample(F.col("onset"), RATE).alias("sample"))
    return sequence.segments_between(view_a(spark, sf), starts)


# ---------------------------------------------------------------- referencing, resampling, filters
on_a(f"WITH {A} SELECT channel, sample, {r('value - avg(value) OVER (PARTITION BY sample)', 'value')} FROM a", "reref_average", filters.rereference)
on_a(f"WITH {A} SELECT channel, sample, {r(chr(39).join(['value - avg(CASE WHEN channel = ', 'view', ' THEN value END) OVER (PARTITION BY sample)']), 'value')} FROM a", "reref_channel", lambda a: filters.rereference(a, "channel", ["view"]))
on_a(f"WITH {A} SELECT channel, sample, {r(chr(39).join(['value - avg(CASE WHEN channel IN (', 'view', ', ', 'click', ') THEN value END) OVER (PARTITION BY sample)']), 'value')} FROM a", "reref_channels", lambda a: filters.rereference(a, "channels", ["view", "click"]))
on_a(
    f"WITH {A}, w AS (SELECT *, lead(value) {_W}) AS nx, max(sample) OVER (PARTITION BY channel) AS n FROM a), z AS (SELECT channel, any_value(n) AS n, greatest(CAST(round_even(any_value(n) / 100.0::DOUBLE * 40.0, 0) AS BIGINT), 1) AS size FROM w GROUP BY channel), "
    "k AS (SELECT channel, k, (n - 1) / CAST(size - 1 AS DOUBLE) AS gap, n FROM z, generate_series(0, 1000000) g(k) WHERE k < size), p AS (SELECT channel, k, k * gap AS pos, least(n, CAST(floor(k * gap + 1e-9) AS BIGINT) + 1) AS sample FROM k) "
    f"SELECT channel, k + 1 AS sample, {r('value + coalesce((pos - (sample - 1)) * (nx - value), 0)', 'value')} FROM p JOIN w USING (channel, sample)",
    "resample_linear", lambda a: filters.resample_linear(a, RATE, 40.0),
)
for _key, _fn in {
    "butterworth_pass": lambda a: filters.butterworth_filter(a, RATE, 8.0, 13.0),
    "fir_low": lambda a: filters.fir_filter(a, RATE, high=20.0, order=50),
    "notch": lambda a: filters.notch_filter(a, RATE, 25.0),
    "sinc_low": lambda a: filters.windowed_sinc(a, RATE, high=20.0),
    "resample_spline": lambda a: filters.resample(a, RATE, 64.0, "spline"),
    "resample_fft": lambda a: filters.resample(a, RATE, 64.0, "fft"),
    "decimate": lambda a: filters.decimate(a, RATE, 2),
    "upsample": lambda a: filters.upsample(a, RATE, 2),
    "hilbert": spectral.hilbert,
    "hilbert_amplitude": lambda a: spectral.amplitude(spectral.hilbert(a)),
    "hilbert_phase": lambda a: spectral.phase(spectral.hilbert(a)),
    "wavelet": lambda a: spectral.wavelet(a, RATE, [5.0, 10.0, 20.0]),
    "wavelet_band_power": lambda a: spectral.wavelet_band_power(a, RATE),
    "fft_magnitude": spectral.fft_magnitude,
    "periodogram": lambda a: spectral.periodogram(a, RATE),
    "psd_first_window": lambda a: spectral.first_window_psd(a, RATE, 64),
    "plv": lambda a: connectivity.plv(a, RATE, ALPHA),
    "pli": lambda a: connectivity.pli(a, RATE, ALPHA),
    "wpli": lambda a: connectivity.wpli(a, RATE, ALPHA),
    "corr_kendall": lambda a: connectivity.correlation(a, "kendall"),
    "emg_envelope": lambda a: emg.envelope(a, RATE),
    "ica": lambda a: decomposition.ica(a).sources,
    "ica_classify": lambda a: decomposition.classify_components(decomposition.ica(a).sources, RATE),
    "ica_remove": lambda a: decomposition.remove_components(decomposition.ica(a), [1]),
    "pca": decomposition.pca_table,
    "nmf": lambda a: decomposition.synergy_table(a, 2),
    "factor_analysis": lambda a: decomposition.synergy_table(a, 2, "factor"),
    "optimal_synergies": lambda a: decomposition.optimal_synergies(a, 4),
    "to_percent": emg.to_percent,
}.items():
    on_a(None, _key, _fn)

# ---------------------------------------------------------------- spectra: DFT of 64-sample Hann windows in SQL
SEG = (
    f"WITH {A}, n AS (SELECT channel, max(sample) AS n FROM a GROUP BY channel), g AS (SELECT channel, s FROM n, generate_series(0, 1000000) t(s) WHERE s * 32 + 64 <= n), "
    "x AS (SELECT g.channel, s, sample - s * 32 - 1 AS i, value * (0.5 - 0.5 * cos(2 * pi() * (sample - s * 32 - 1) / 63.0)) AS v FROM g JOIN a ON a.channel = g.channel AND sample BETWEEN s * 32 + 1 AND s * 32 + 64), "
    "f AS (SELECT channel, s, k, sum(v * cos(2 * pi() * k * i / 64.0)) AS re, -sum(v * sin(2 * pi() * k * i / 64.0)) AS im FROM x, generate_series(0, 32) t(k) GROUP BY channel, s, k), "
    "d AS (SELECT *, (re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / (100.0 * 23.625) AS p FROM f), "
    "w AS (SELECT channel, k, avg(p) AS p FROM d GROUP BY channel, k) "
)
on_a(SEG + f"SELECT channel, CAST(s AS BIGINT) AS segment, {r('(s * 64 + 65) / 200.0', 'time')}, {r('k * 100.0 / 64', 'frequency')}, {r('p', 'power')} FROM d", "spectrogram", lambda a: spectral.spectrogram(a, RATE, 64))
on_a(SEG + f"SELECT channel, {r('k * 100.0 / 64', 'frequency')}, {r('10 * log10(p + 1e-10)', 'power')} FROM w", "welch_psd_db", lambda a: spectral.welch(a, RATE, 64).withColumn("power", spectral.in_decibels(F.col("power"))))
on_a(SEG + f"SELECT channel, {r('k * 100.0 / 64', 'frequency')}, {r('p', 'power')} FROM w", "welch_psd", lambda a: spectral.welch(a, RATE, 64))
_BANDS = ", ".join(f"({k!r}, {lo}, {hi})" for k, (lo, hi) in spectral.BANDS.items())
on_a(SEG + f", o(band, lo, hi) AS (VALUES {_BANDS}), q AS (SELECT channel, band, sum(p) AS p FROM w JOIN o ON k * 100.0 / 64 BETWEEN lo AND hi GROUP BY channel, band) SELECT channel, band, {r('p / sum(p) OVER (PARTITION BY channel)', 'power')} FROM q", "band_power", lambda a: spectral.band_power(a, RATE, size=64, relative=True))
CROSS = SEG + ", c AS (SELECT l.channel AS a, q.channel AS b, l.k, avg(l.re * q.re + l.im * q.im) AS re, avg(l.im * q.re - l.re * q.im) AS im FROM f l JOIN f q ON l.s = q.s AND l.k = q.k AND l.channel <= q.channel GROUP BY ALL) "
on_a(CROSS + f"SELECT a, b, {r('k * 100.0 / 64', 'frequency')}, {r('re', 're')}, {r('im', 'im')} FROM c", "csd", lambda a: connectivity.cross_spectrum(a, RATE, 64))
on_a(CROSS + f"SELECT c.a, c.b, {r('c.k * 100.0 / 64', 'frequency')}, {r('(c.re * c.re + c.im * c.im) / (x.re * y.re)', 'value')} FROM c JOIN c x ON x.a = c.a AND x.b = c.a AND x.k = c.k JOIN c y ON y.a = c.b AND y.b = c.b AND y.k = c.k WHERE c.a < c.b", "coherence", lambda a: connectivity.coherence(a, RATE, 64))

# ---------------------------------------------------------------- connectivity and networks
C = f"{A}, pr AS (SELECT l.channel AS a, q.channel AS b, sample, l.value AS x, q.value AS y FROM a l JOIN a q USING (sample) WHERE l.channel < q.channel), c AS (SELECT a, b, corr(x, y) AS value FROM pr GROUP BY a, b)"
on_a(f"WITH {C} SELECT a, b, {r('value', 'value')} FROM c", "corr_pearson", connectivity.correlation)
on_a(
    f"WITH {C}, k AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM pr) SELECT a, b, {r('corr(rx, ry)', 'value')} FROM k GROUP BY a, b",
    "corr_spearman", lambda a: connectivity.correlation(a, "spearman"),
)
DYN = (
    f"WITH {A}, n AS (SELECT channel, max(sample) AS n FROM a GROUP BY channel), v AS (SELECT a.channel, w + 1 AS win, sample - w * 32 AS sample, value FROM a JOIN n USING (channel), generate_series(0, 1000000) t(w) WHERE w <= n // 32 AND w * 32 + 64 <= n AND sample BETWEEN w * 32 + 1 AND w * 32 + 64), "
    "d AS (SELECT CAST(l.win AS BIGINT) AS win, l.channel AS a, q.channel AS b, corr(l.value, q.value) AS value FROM v l JOIN v q ON l.win = q.win AND l.sample = q.sample AND l.channel < q.channel GROUP BY ALL) "
)
on_a(DYN + f"SELECT win AS \"window\", a, b, {r('value', 'value')}, {r('((win - 1) * 64 + 64) / 200.0', 'time')} FROM d", "sliding_corr", lambda a: connectivity.sliding_connectivity(a, RATE, 64, 32))
on_a(DYN + f"SELECT d.win AS \"window\", {r('corr(d.value, x.value)', 'stability')} FROM d JOIN d x ON x.win = d.win + 1 AND x.a = d.a AND x.b = d.b GROUP BY d.win", "temporal_stability", lambda a: connectivity.temporal_stability(connectivity.sliding_connectivity(a, RATE, 64, 32)))
on_a(DYN + f"SELECT win AS \"window\", {r('avg(value)', 'value')} FROM d GROUP BY win", "mean_connectivity", lambda a: views.mean_connectivity(connectivity.sliding_connectivity(a, RATE, 64, 32)))

NET = f"WITH {C}, o AS (SELECT a AS src, b AS dst, abs(value) AS weight FROM c), net AS (SELECT * FROM o UNION ALL SELECT dst, src, weight FROM o)"
THIN = NET + ", kk AS (SELECT *, rank() OVER (ORDER BY weight DESC) AS place, count(*) OVER () AS n FROM o), th AS (SELECT src, dst, weight FROM kk WHERE place <= ceil(n * 0.6)), tn AS (SELECT * FROM th UNION ALL SELECT dst, src, weight FROM th)"


def net_of(a: DataFrame) -> DataFrame:
    return network.adjacency(connectivity.correlation(a))


def thin_of(a: DataFrame) -> DataFrame:
    return network.density_threshold(net_of(a), 0.6)


on_a(NET + f" SELECT src, dst, {r('weight', 'weight')} FROM net", "adjacency", net_of)
on_a(THIN + f" SELECT src, dst, {r('weight', 'weight')} FROM tn", "density_threshold", thin_of)
on_a(THIN + " SELECT src, dst, 1.0::DOUBLE AS weight FROM tn", "binarize", lambda a: network.binarize(thin_of(a)))
on_a(THIN + " SELECT src AS node, CAST(count(*) AS DOUBLE) AS degree FROM tn GROUP BY src", "degree", lambda a: network.degree(thin_of(a)))
on_a(NET + f" SELECT src AS node, {r('sum(weight)', 'degree')} FROM net GROUP BY src", "strength", lambda a: network.degree(net_of(a), True))
_TRI = "tri AS (SELECT x.src AS node, sum({w}) AS t FROM {n} x JOIN {n} y ON x.src = y.src AND x.dst < y.dst JOIN {n} z ON z.src = x.dst AND z.dst = y.dst GROUP BY x.src), dg AS (SELECT src AS node, count(*) AS k FROM {n} GROUP BY src) SELECT node, {v} FROM dg LEFT JOIN tri USING (node)"
_CC = r("CASE WHEN k >= 2 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END", "clustering")
on_a(THIN + ", " + _TRI.format(w="1.0", n="tn", v=_CC), "clustering", lambda a: network.clustering(thin_of(a)))
on_a(NET + ", mx AS (SELECT max(weight) AS w FROM net), sc AS (SELECT src, dst, weight / w AS weight FROM net, mx), " + _TRI.format(w="cbrt(x.weight * y.weight * z.weight)", n="sc", v=_CC), "clustering_weighted", lambda a: network.clustering(net_of(a), True))
on_a(NET + f" SELECT src, dst, {r('-weight', 'value')} FROM net UNION ALL SELECT src, src, {r('sum(weight)', 'value')} FROM net GROUP BY src", "laplacian", lambda a: network.laplacian(net_of(a)))
PATHS = THIN.replace("WITH ", "WITH RECURSIVE ", 1) + ", walk(src, dst, d) AS (SELECT src, dst, 1 FROM tn UNION SELECT walk.src, tn.dst, d + 1 FROM walk JOIN tn ON walk.dst = tn.src WHERE d < 6), dist AS (SELECT src, dst, min(d) AS d FROM walk WHERE src <> dst GROUP BY src, dst)"
on_a(PATHS + ", nd AS (SELECT DISTINCT src AS v FROM tn) SELECT p.v AS src, q.v AS dst, coalesce(CAST(d AS DOUBLE), 'inf'::DOUBLE) AS distance FROM nd p JOIN nd q ON p.v <> q.v LEFT JOIN dist ON src = p.v AND dst = q.v", "path_length", lambda a: network.path_lengths(thin_of(a)))
on_a(PATHS + f", nd AS (SELECT count(DISTINCT src) AS n FROM tn) SELECT {r('sum(1.0::DOUBLE / d) / any_value(n * (n - 1))', 'global_efficiency')} FROM dist, nd", "global_efficiency", lambda a: network.efficiency(thin_of(a)))
on_a(NET + f", cm AS (SELECT DISTINCT src AS node, src < 'p' AS community FROM net), st AS (SELECT community, sum(weight) AS k FROM net JOIN cm ON node = src GROUP BY community), ins AS (SELECT sum(weight) AS w FROM net JOIN cm x ON x.node = src JOIN cm y ON y.node = dst WHERE x.community = y.community) SELECT {r('any_value(w) / sum(k) - sum(k * k) / (sum(k) * sum(k))', 'modularity')} FROM st, ins", "modularity", lambda a: network.modularity(net_of(a), a.select(F.col("channel").alias("node")).distinct().withColumn("community", F.col("node") < "p")))
on_a(THIN + f" SELECT {r('count(*) / (count(DISTINCT src) * (count(DISTINCT src) - 1.0))', 'density')} FROM tn", "edge_density", lambda a: network.edge_density(thin_of(a)))
on_a(None, "node_metrics", lambda a: network.node_metrics(thin_of(a)))
on_a(None, "spectral_clusters", lambda a: network.clusters(net_of(a), 2))
on_a(None, "laplacian_eigenvalues", lambda a: network.eigenvalues(net_of(a)))
on_a(None, "small_world", lambda a: network.small_world(thin_of(a)))
on_a(None, "network_view", lambda a: views.network_view(thin_of(a), network.degree(thin_of(a)), "degree")[0])

# ---------------------------------------------------------------- artifacts
_LIM = "md AS (SELECT channel, median(v) AS m FROM z GROUP BY channel), lm AS (SELECT channel, any_value(m) + 5 * 1.4826::DOUBLE * median(abs(v - m)) AS lim FROM z JOIN md USING (channel) GROUP BY channel), h AS (SELECT channel, sample, v FROM z JOIN lm USING (channel) WHERE v > lim), i AS (SELECT *, CASE WHEN sample - lag(sample) OVER (PARTITION BY channel ORDER BY sample) <= 10 THEN 0 ELSE 1 END AS new FROM h), j AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY sample) AS isl FROM i) " + f"SELECT channel, {r('(min(sample) - 1) / 100.0', 'onset')}, {r('max(sample) / 100.0', 'offset')}, count(*) AS extent, {r('max(v)', 'peak')} FROM j GROUP BY channel, isl"
on_a(f"WITH {A}, z AS (SELECT channel, sample, abs(value) AS v FROM a), {_LIM}", "artifacts_amplitude", lambda a: artifacts.detect_artifacts(a, RATE))
on_a(f"WITH {A}, z AS (SELECT channel, sample, coalesce(abs(value - lag(value) {_W})), 0) AS v FROM a), {_LIM}", "artifacts_gradient", lambda a: artifacts.detect_artifacts(a, RATE, "gradient"))
_VAR = f"WITH {A}, v AS (SELECT channel, var_samp(value) AS v FROM a GROUP BY channel), m AS (SELECT median(v) AS m FROM v)"
on_a(_VAR + f", q AS (SELECT 1.4826::DOUBLE * median(abs(v - m)) AS mad, any_value(m) AS m FROM v, m) SELECT channel, {r('abs(v - m) / (mad + 1e-10)', 'score')}, abs(v - m) / (mad + 1e-10) > 3 AS bad FROM v, q", "bad_channels_zscore", artifacts.bad_channels)
on_a(_VAR + f" SELECT channel, {r('v / m', 'score')}, v < 0.01 * m AS bad FROM v, m", "bad_channels_flat", lambda a: artifacts.bad_channels(a, "flat"))
on_a(NET + f", n AS (SELECT count(DISTINCT channel) AS n FROM a) SELECT src AS channel, {r('sum(weight) / any_value(n)', 'score')}, sum(weight) / any_value(n) < 0.4 AS bad FROM net, n GROUP BY src", "bad_channels_corr", lambda a: artifacts.bad_channels(a, "correlation"))
on_a(f"WITH {A}, g AS (SELECT * FROM a WHERE channel <> 'error') SELECT channel, sample, {r('value', 'value')} FROM g UNION ALL SELECT 'error', sample, {r('avg(value)', 'value')} FROM g GROUP BY sample", "interpolate_bad", lambda a: artifacts.interpolate_bad(a, ["error"]))
_POS = "ps(channel, px, py, pz) AS (VALUES ('click', 0.0, 1.0, 0.0), ('error', 0.5, 0.2, 0.1), ('purchase', -1.0, 0.0, 0.0), ('signup', 0.0, -1.0, 0.5), ('view', 1.0, 0.0, 0.0))"
POSITIONS = [("click", 0.0, 1.0, 0.0), ("error", 0.5, 0.2, 0.1), ("purchase", -1.0, 0.0, 0.0), ("signup", 0.0, -1.0, 0.5), ("view", 1.0, 0.0, 0.0)]


def positions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POSITIONS, "channel string, pos_x double, pos_y double, pos_z double")


@query(f"WITH {A}, {_POS}, w AS (SELECT g.channel, 1 / (sqrt((g.px - e.px) ** 2 + (g.py - e.py) ** 2 + (g.pz - e.pz) ** 2)::DOUBLE + 1e-10::DOUBLE) AS w FROM ps g, ps e WHERE e.channel = 'error' AND g.channel <> 'error') SELECT channel, sample, {r('value', 'value')} FROM a WHERE channel <> 'error' UNION ALL SELECT 'error', sample, {r('sum(w * value) / sum(w)', 'value')} FROM a JOIN w USING (channel) GROUP BY sample")
def interpolate_bad_distance(spark, sf):
    return artifacts.interpolate_bad(view_a(spark, sf), ["error"], positions(spark))


@query(
    f"WITH {A}, {_POS}, v AS (SELECT channel, avg(value) AS value FROM a GROUP BY channel), g AS (SELECT -1.0::DOUBLE + i * (2.0::DOUBLE / 15) AS x, -1.0::DOUBLE + j * (2.0::DOUBLE / 15) AS y FROM generate_series(0, 15) p(i), generate_series(0, 15) q(j)), "
    "d AS (SELECT x, y, value, greatest(sqrt((x - px) ** 2 + (y - py) ** 2), 1e-12) AS d FROM g, v JOIN ps USING (channel) WHERE x * x + y * y <= 1.0) "
    f"SELECT {r('x', 'x')}, {r('y', 'y')}, {r('CASE WHEN min(d) < 1e-10 THEN arg_min(value, d) ELSE sum(value * d ** -2) / sum(d ** -2) END', 'value')} FROM d GROUP BY x, y"
)
def topomap_idw(spark, sf):
    means = view_a(spark, sf).groupBy("channel").agg(F.avg("value").alias("value"))
    return views.topomap(means, positions(spark), resolution=16)


on_a(f"WITH {A}, t AS (SELECT 1.5 * max(abs(value)) AS s FROM a), k AS (SELECT channel, row_number() OVER (ORDER BY channel) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT channel FROM a)) SELECT channel, {r('(sample - 1) / 100.0', 'time')}, {r('value', 'value')}, {r('value + (n - k) * s', 'shifted')} FROM a JOIN k USING (channel), t", "stacked_traces", lambda a: views.stacked_traces(a, RATE))


# ---------------------------------------------------------------- statistics on view B
_ONE = "avg(value) FILTER (condition = {c}) AS m{k}, var_samp(value) FILTER (condition = {c}) AS v{k}, count(value) FILTER (condition = {c}) AS n{k}"
TWO = f"WITH {B}, s AS (SELECT sample, {_ONE.format(c=0, k=1)}, {_ONE.format(c=1, k=2)} FROM b GROUP BY sample) "


def on_b(sql: str | None, key: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    query(sql, key)(lambda spark, sf: fn(view_b(spark, sf)))


on_b(TWO + f"SELECT sample, {r('m1 / sqrt(v1 / n1)', 't')}, CAST(n1 - 1 AS DOUBLE) AS df FROM s", "ttest_one", lambda b: stats.t_test(b, 0))
on_b(TWO + f"SELECT sample, {r('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)', 't')}, {r('(v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))', 'df')} FROM s", "ttest_welch", lambda b: stats.t_test(b, 0, 1))
on_b(TWO + f"SELECT sample, {r('(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2))', 't')}, CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM s", "ttest_pooled", lambda b: stats.t_test(b, 0, 1, equal_var=True))
on_b(None, "ttest_p", lambda b: stats.with_p(stats.t_test(b, 0, 1)))
on_b(TWO + f", d AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM s), q AS (SELECT *, sqrt((n1 + n2) / CAST(n1 * n2 AS DOUBLE) + d * d / (2.0 * (n1 + n2))) AS se FROM d) SELECT sample, {r('d', 'd')}, {r('d - 1.96 * se', 'low')}, {r('d + 1.96 * se', 'high')} FROM q", "cohens_d", lambda b: stats.effect_size(b, 0, 1))


def pairs_of(b: DataFrame) -> DataFrame:
    """The k-th epoch of condition 0 with the k-th of condition 1."""
    one = b.select("epoch", "condition").distinct().withColumn("k", F.row_number().over(Window.partitionBy("condition").orderBy("epoch")))
    return one.filter("condition = 0").select(F.col("epoch").alias("epoch1"), "k").join(one.filter("condition = 1").select(F.col("epoch").alias("epoch2"), "k"), "k").drop("k")


PAIRED = f"WITH {B}, o AS (SELECT epoch, condition, row_number() OVER (PARTITION BY condition ORDER BY epoch) AS k FROM (SELECT DISTINCT epoch, condition FROM b)), d AS (SELECT x.sample, x.value - y.value AS d FROM o p JOIN o q ON p.k = q.k AND p.condition = 0 AND q.condition = 1 JOIN b x ON x.epoch = p.epoch JOIN b y ON y.epoch = q.epoch AND y.sample = x.sample) "
on_b(PAIRED + f"SELECT sample, {r('avg(d) / (stddev_samp(d) / sqrt(count(d)))', 't')}, CAST(count(d) - 1 AS DOUBLE) AS df FROM d GROUP BY sample", "ttest_paired", lambda b: stats.paired_t_test(b, pairs_of(b)))
ANOVA = f"WITH {B}, g AS (SELECT sample, condition, count(value) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM b GROUP BY sample, condition), s AS (SELECT sample, count(*) AS k, sum(n) AS n, sum(n * m) AS nm, sum(n * m * m) AS nmm, sum((n - 1) * v) AS w FROM g GROUP BY sample) "
on_b(ANOVA + f"SELECT sample, {r('((nmm - nm * nm / n) / (k - 1)) / (w / (n - k))', 'f')}, CAST(k - 1 AS DOUBLE) AS df1, CAST(n - k AS DOUBLE) AS df2 FROM s", "anova_f", stats.anova)
on_b(None, "anova_p", lambda b: stats.anova_with_p(stats.anova(b)))


def pseudo_p(spark: SparkSession, sf: str) -> DataFrame:
    """A p-like number in (0, 1) for each sample of view A, from its value."""
    return view_a(spark, sf).select("channel", "sample", (1 / (1 + F.abs("value"))).alias("p"))


_P = f"{A}, p AS (SELECT channel, sample, 1 / (1 + abs(value)) AS p FROM a), o AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY p, sample) AS k, count(*) OVER (PARTITION BY channel) AS n FROM p)"
for _method, _sql in (
    ("BH", "least(1, min(p * n / k) OVER (PARTITION BY channel ORDER BY k DESC))"),
    ("holm", "least(1, max(p * (n - k + 1)) OVER (PARTITION BY channel ORDER BY k))"),
    ("bonferroni", "least(1, p * n)"),
):
    query(f"WITH {_P} SELECT channel, sample, {r('p', 'p')}, {r(_sql, 'p_adjusted')} FROM o", f"p_adjust_{_method.lower()}")(lambda spark, sf, m=_method: sequence.adjust_p(pseudo_p(spark, sf), method=m, by=["channel"]))


@query(f"WITH {_P}, h AS (SELECT channel, sample, p, sample - row_number() OVER (PARTITION BY channel ORDER BY sample) AS isl FROM p WHERE p < 0.02), q AS (SELECT channel, min(sample) AS s, max(sample) AS e, min(p) AS mp FROM h GROUP BY channel, isl) SELECT channel, s AS start, e AS \"end\", {r('mp', 'min_p')} FROM q WHERE (e - s) / 100.0 >= 0.02")
def significant_windows(spark, sf):
    return sequence.significant_windows(pseudo_p(spark, sf), 0.02, 0.02, RATE)


_FW = "c AS (SELECT sample, {t} AS x FROM {s}), st AS (SELECT x, x - lag(x) OVER (ORDER BY sample) AS d FROM c) SELECT " + r("greatest(1, least(count(*), sqrt(4 * ln(2) * var_samp(x) / var_samp(d))))", "fwhm") + ", count(*) AS n FROM st"
on_b(TWO + ", " + _FW.format(t="(m1 - m2) / sqrt(v1 / n1 + v2 / n2)", s="s"), "spm_fwhm", lambda b: stats.fwhm(stats.t_test(b, 0, 1), "t"))
on_b(None, "spm_t", lambda b: stats.spm(stats.t_test(b, 0, 1, equal_var=True))[0])
on_b(None, "spm_t_clusters", lambda b: stats.spm(stats.t_test(b, 0, 1, equal_var=True), alpha=0.5)[1])
on_b(None, "spm_paired", lambda b: stats.spm(stats.paired_t_test(b, pairs_of(b)))[0])
on_b(None, "spm_anova", lambda b: stats.spm(stats.anova(b), "f")[0])
on_b(None, "cluster_permutation", lambda b: stats.cluster_permutation(b, 0, 1))
on_b(None, "bootstrap_ci", lambda b: stats.bootstrap_ci(b))


def synergies_of(b: DataFrame, lo: int) -> DataFrame:
    """The mean vector of each label as a synergy over the 64 places; ``lo`` shifts the labels."""
    return b.groupBy(((F.col("condition") + lo) % 10).cast("int").alias("synergy"), F.col("sample").alias("channel")).agg(F.avg("value").alias("weight"))


on_b(
    f"WITH {B}, m AS (SELECT condition % 10 AS l, (condition + 1) % 10 AS r, sample, avg(value) AS w FROM b GROUP BY ALL) SELECT CAST(x.l AS BIGINT) AS \"left\", CAST(y.r AS BIGINT) AS \"right\", {r('sum(x.w * y.w) / sqrt(sum(x.w * x.w) * sum(y.w * y.w))', 'similarity')} FROM m x JOIN m y USING (sample) GROUP BY x.l, y.r",
    "synergy_similarity", lambda b: decomposition.synergy_similarity(synergies_of(b, 0), synergies_of(b, 1)),
)


@query()
def dtw_distance(spark, sf):
    vectors = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"))
    means = view_b(spark, sf).groupBy("condition", "sample").agg(F.avg("value").alias("value"))
    references = means.groupBy(F.col("condition").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "value"))), lambda x: x["value"]).alias("values"))
    return emg.warp_distances(vectors, references)


# ---------------------------------------------------------------- muscle activity
on_a(f"WITH {A} SELECT channel, sample, {r('abs(value)', 'value')} FROM a", "emg_rectify", emg.rectify)
on_a(f"WITH {A}, q AS (SELECT *, avg(abs(value)) {_W} ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS s FROM a), m AS (SELECT channel, max(s) AS mvc FROM q GROUP BY channel) SELECT channel, sample, {r('100 * value / mvc', 'value')} FROM a JOIN m USING (channel)", "mvc_normalize", emg.normalize)
_ON = f"WITH {A}, n AS (SELECT *, greatest(count(*) OVER (PARTITION BY channel) // 10, 100) AS lim FROM a), l AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS s FROM n WHERE sample <= lim GROUP BY channel), h AS (SELECT channel, sample, sample - row_number() OVER (PARTITION BY channel ORDER BY sample) AS isl FROM n JOIN l USING (channel) WHERE value > m + s), q AS (SELECT channel, min(sample) AS s, max(sample) AS e FROM h GROUP BY channel, isl) "
on_a(_ON + "SELECT channel, s AS start, e AS \"end\" FROM q WHERE e - s + 1 >= 2", "emg_onset", lambda a: emg.bursts(a, RATE, 0.02, k=1.0))
on_a(_ON + f", z AS (SELECT channel, count(*) AS n FROM a GROUP BY channel), c AS (SELECT channel, count(*) AS b, avg(e - s + 1) AS d, sum(e - s + 1) AS t FROM q WHERE e - s + 1 >= 2 GROUP BY channel) SELECT channel, coalesce(b, 0) AS n_bursts, {r('d / 100.0', 'mean_duration')}, {r('100.0 * coalesce(t, 0) / n', 'duty')} FROM z LEFT JOIN c USING (channel)", "activation_timing", lambda a: emg.activation_timing(a, RATE, min_duration=0.02, k=1.0))
on_a(f"WITH {A}, p AS (SELECT sample, abs(max(value) FILTER (channel = 'click')) AS a, abs(max(value) FILTER (channel = 'view')) AS b FROM a WHERE channel IN ('click', 'view') GROUP BY sample HAVING count(*) = 2) SELECT sample, {r('coalesce(2 * least(a, b) / nullif(a + b, 0), 0)', 'value')} FROM p", "cocontraction", lambda a: emg.cocontraction(a, "click", "view"))
FREQ = SEG + ", q AS (SELECT channel, s, k, re * re + im * im AS p FROM f), u AS (SELECT *, sum(p) OVER (PARTITION BY channel, s ORDER BY k) AS upto, sum(p) OVER (PARTITION BY channel, s) AS total FROM q), e AS (SELECT channel, CAST(s AS BIGINT) AS segment, min(k * 100.0::DOUBLE / 64) FILTER (upto >= total / 2) AS mdf, sum(k * 100.0::DOUBLE / 64 * p) / sum(p) AS mnf, arg_max(k * 100.0::DOUBLE / 64, p) AS pkf FROM u GROUP BY channel, s) "
on_a(FREQ + f"SELECT channel, segment, {r('mdf', 'median_frequency')}, {r('mnf', 'mean_frequency')}, {r('pkf', 'peak_frequency')} FROM e", "emg_frequencies", lambda a: emg.spectral_frequencies(a, RATE, 64))
on_a(FREQ + f"SELECT channel, {r('100 * regr_slope(mnf, segment) * count(*) / arg_min(mnf, segment)', 'fatigue')} FROM e GROUP BY channel", "fatigue_slope", lambda a: emg.fatigue(emg.spectral_frequencies(a, RATE, 64), "mean_frequency"))
on_a(
    f"WITH {A}, s AS (SELECT *, lag(value) {_W}) AS p, lead(value) {_W}) AS q, 0.01 * avg(abs(value)) OVER (PARTITION BY channel) AS l FROM a) SELECT channel, {r('avg(abs(value))', 'mav')}, {r('sqrt(avg(value * value))', 'rms')}, {r('sum(abs(value - p))', 'wl')}, "
    "count(*) FILTER (value * p < 0 AND abs(value - p) >= l) AS zc, count(*) FILTER ((value - p) * (value - q) > 0 AND (abs(value - p) >= l OR abs(value - q) >= l)) AS ssc, "
    f"{r('sum(abs(value))', 'iemg')}, {r('var_samp(value)', 'var')} FROM s GROUP BY channel",
    "emg_time_features", emg.time_features,
)
on_a(None, "emg_features", lambda a: emg.features(a, RATE, 64))
on_a(None, "firing", lambda a: emg.firing(a, RATE))
on_a(None, "spike_average", lambda a: emg.spike_average(a, RATE, 0.05))


# ---------------------------------------------------------------- catalogue
def experiments(spark: SparkSession, sf: str) -> DataFrame:
    """orders as experiments."""
    o = load(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("experiment_id"), F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderpriority").alias("task"), F.col("o_orderdate").cast("date").alias("recording_date"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS experiment_id, CAST(o_custkey AS VARCHAR) AS subject_id FROM orders WHERE o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def catalog_query(spark, sf):
    return catalog.find_experiments(experiments(spark, sf), task="1-URGENT", date_range=("1995-01-01", "1996-12-31")).select("experiment_id", "subject_id")


@query("SELECT (SELECT count(*) FROM orders) AS n_experiments, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_subjects, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS n_tasks, (SELECT count(*) FROM lineitem) AS n_channels, (SELECT count(*) FROM events) AS n_events, (SELECT count(*) FROM embeddings) AS n_chunks")
def catalog_stats(spark, sf):
    return catalog.statistics(experiments(spark, sf), load(spark, sf, "lineitem"), load(spark, sf, "events"), load(spark, sf, "embeddings"))


on_a(f"WITH {A} SELECT channel, min(sample) AS start_sample, max(sample) AS end_sample, {r('sum(value)', 'total')}, count(*) AS n FROM a GROUP BY channel, (sample - 1) // 100", "catalog_chunks", lambda a: catalog.chunk_signals(a, 100).select("channel", "start_sample", "end_sample", F.aggregate("data", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("data").alias("n")))
on_a(f"WITH {A} SELECT channel, sample, {r('value', 'value')} FROM a", "catalog_chunk_round_trip", lambda a: catalog.unchunk_signals(catalog.chunk_signals(a, 100)))
