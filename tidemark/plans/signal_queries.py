"""Signal and spectral features over hourly event sums and embeddings as spectra."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import signal as S
from ..sources import tables as T
from .registry import register


def _rounded(df, digits, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


@register("energy_blocks", "SELECT series, k // 24 AS block, count(*) AS n, round(20 * log10(greatest(sqrt(avg(x * x)), 1e-8)), 6) AS rms_db FROM signal GROUP BY ALL", T.SIGNAL_SQL)
def energy_blocks(spark, sf):
    return _rounded(S.energy_blocks(T.signal(spark, sf), 24), 6, "rms_db")


@register("signal_rms_peak", "SELECT series, round(sqrt(avg(x * x)), 6) AS rms, max(abs(x)) AS peak, round(20 * log10(greatest(sqrt(avg(x * x)), 1e-8)), 6) AS rms_db, round(20 * log10(greatest(max(abs(x)), 1e-8)), 6) AS peak_db FROM signal GROUP BY series", T.SIGNAL_SQL)
def signal_rms_peak(spark, sf):
    return _rounded(S.levels(T.signal(spark, sf)), 6, "rms", "rms_db", "peak_db")


@register("peak_gain", "SELECT series, max(abs(x)) AS peak, round(coalesce(least(1.0::DOUBLE, 0.891250938::DOUBLE / nullif(max(abs(x)), 0.0)), 1.0), 9) AS gain FROM signal GROUP BY series", T.SIGNAL_SQL)
def peak_gain(spark, sf):
    return _rounded(S.peak_gain(T.signal(spark, sf)), 9, "gain")


@register("attack_derivative", "SELECT series, block, round(a, 6) AS amplitude, round(greatest(0.0::DOUBLE, a - coalesce(lag(a) OVER (PARTITION BY series ORDER BY block), 0.0)), 6) AS rise FROM (SELECT series, k // 4 AS block, sqrt(avg(x * x)) AS a FROM signal GROUP BY ALL)", T.SIGNAL_SQL)
def attack_derivative(spark, sf):
    return _rounded(S.attack_derivative(T.signal(spark, sf), 4), 6, "amplitude", "rise")


ONSET = (
    "onset0 AS (SELECT series, k, greatest(0.0::DOUBLE, x - avg(x) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS o FROM signal), "
    "onset AS (SELECT series, k, least(5.0::DOUBLE, o / greatest(sqrt(avg(o * o) OVER (PARTITION BY series)) * 0.15 + 1e-7, sqrt(avg(o * o) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 36 PRECEDING AND 36 FOLLOWING)))) AS onset FROM onset0)"
)


@register("onset_normalize", "SELECT series, k, round(onset, 6) AS onset FROM onset", T.SIGNAL_SQL, ONSET)
def onset_normalize(spark, sf):
    return _rounded(S.normalise(T.signal(spark, sf), 3, 36), 6, "onset").select("series", "k", "onset")


_W = [math.exp(-0.5 * (j / 1.5) ** 2) for j in range(-5, 6)]


@register(
    "gaussian_smooth",
    "SELECT a.series, a.k, round(sum(b.x * exp(-0.5 * power((b.k - a.k) / 1.5::DOUBLE, 2))) / %r::DOUBLE, 4) AS smooth FROM signal a JOIN signal b ON a.series = b.series AND b.k BETWEEN a.k - 5 AND a.k + 5 GROUP BY a.series, a.k" % sum(_W),
    T.SIGNAL_SQL,
)
def gaussian_smooth(spark, sf):
    return _rounded(S.gaussian(T.signal(spark, sf), 1.5), 4, "smooth").select("series", "k", "smooth")


def _acf(lags: int) -> str:
    return (
        "cen AS (SELECT series, k, x - avg(x) OVER (PARTITION BY series) AS c FROM signal), "
        "en AS (SELECT series, greatest(sum(c * c), 1e-12) AS e, count(*) AS n FROM cen GROUP BY series), "
        f"acf AS (SELECT a.series, a.k - b.k AS lag, sum(a.c * b.c) / any_value(e) * any_value(n) / greatest(1, any_value(n) - (a.k - b.k)) AS r FROM cen a JOIN cen b ON a.series = b.series AND a.k - b.k BETWEEN 0 AND {lags} JOIN en ON en.series = a.series GROUP BY a.series, a.k - b.k)"
    )


@register("autocorrelation", "SELECT series, lag, round(r, 6) AS r FROM acf", T.SIGNAL_SQL, _acf(48))
def autocorrelation(spark, sf):
    return _rounded(S.autocorrelation(T.signal(spark, sf), 48), 6, "r")


SUPPORT = (
    "lookup AS (SELECT series, lag, r, lead(r) OVER (PARTITION BY series ORDER BY lag) AS nx FROM acf), "
    "asked AS (SELECT series, i, 6.0::DOUBLE + i * 0.125::DOUBLE AS period, h, w FROM (SELECT DISTINCT series FROM acf) CROSS JOIN (SELECT unnest(range(0, 145)) AS i) CROSS JOIN (VALUES (1, 1.0::DOUBLE), (2, 0.5::DOUBLE), (3, 0.25::DOUBLE), (4, 0.125::DOUBLE)) v(h, w)), "
    "support AS (SELECT a.series, i, any_value(period) AS period, sum(w * coalesce(CASE WHEN nx IS NOT NULL THEN r + (period * h - lag) * (nx - r) ELSE 0.0 END, 0.0)) / 1.875 AS support FROM asked a LEFT JOIN lookup l ON a.series = l.series AND l.lag = floor(period * h)::BIGINT GROUP BY a.series, i), "
    "around AS (SELECT *, lag(support) OVER w AS before, lead(support) OVER w AS after FROM support WINDOW w AS (PARTITION BY series ORDER BY i)), "
    "cand AS (SELECT series, i, period, support FROM around WHERE coalesce(support >= before, after IS NOT NULL) AND coalesce(support > after, support > before)), "
    "scored AS (SELECT series, i, 60.0 / (period * 0.05) AS bpm, least(1.0::DOUBLE, greatest(0.0::DOUBLE, support)) AS support FROM cand)"
)


def _support(spark, sf):
    return S.harmonic_support(S.autocorrelation(T.signal(spark, sf), 100), 6.0, 24.0)


@register("harmonic_support", "SELECT series, i, period, round(support, 6) AS support FROM support", T.SIGNAL_SQL, _acf(100), SUPPORT)
def harmonic_support(spark, sf):
    return _rounded(_support(spark, sf), 6, "support")


@register("harmonic_candidates", "SELECT series, i, period, round(support, 6) AS support FROM cand", T.SIGNAL_SQL, _acf(100), SUPPORT)
def harmonic_candidates(spark, sf):
    return _rounded(S.candidates(_support(spark, sf)), 6, "support")


@register(
    "tempo_top8",
    "SELECT series, rank, round(bpm, 6) AS bpm, round(support, 6) AS support, round(ranked, 6) AS ranked FROM (SELECT *, support * (1.0 + 0.12 * ln(bpm / 40.0)) AS ranked, row_number() OVER (PARTITION BY series ORDER BY support * (1.0 + 0.12 * ln(bpm / 40.0)) DESC, i)::INT AS rank FROM scored) WHERE rank <= 8",
    T.SIGNAL_SQL,
    _acf(100),
    SUPPORT,
)
def tempo_top8(spark, sf):
    return _rounded(S.tempo_top(S.candidates(_support(spark, sf)), 0.05), 6, "bpm", "support", "ranked")


BEFORE = "long AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY series, bin ORDER BY frame), 0.0) AS before FROM bins)"
WHITE = (
    "white AS (SELECT *, coalesce(exp(max(CASE WHEN m > 0 THEN ln(m) + frame / 16.0::DOUBLE END) OVER (PARTITION BY series, bin ORDER BY frame) - frame / 16.0::DOUBLE), 0.0) AS whitening FROM long)"
)


@register("decayed_max", "SELECT series, frame, bin::INT AS bin, round(whitening, 6) AS whitening FROM white", T.FRAMES_SQL, T.BINS_SQL, BEFORE, WHITE)
def decayed_max(spark, sf):
    return _rounded(S.decayed_max(S.bins(T.frames(spark, sf)), 16.0), 6, "whitening").select("series", "frame", "bin", "whitening")


@register(
    "positive_flux",
    "SELECT series, frame, round(CASE WHEN sum(greatest(0.0::DOUBLE, m - before)) / greatest(1e-9, sum(m)) > 0.005 THEN sum(greatest(0.0::DOUBLE, l - pl) * CASE WHEN bin < 8 THEN 1.3 ELSE 1.0 END) ELSE 0.0 END, 4) AS flux "
    "FROM (SELECT *, coalesce(lag(l) OVER (PARTITION BY series, bin ORDER BY frame), 0.0) AS pl FROM (SELECT *, ln(1.0 + 10.0 * m / greatest(1e-4, whitening)) AS l FROM white)) GROUP BY series, frame",
    T.FRAMES_SQL,
    T.BINS_SQL,
    BEFORE,
    WHITE,
)
def positive_flux(spark, sf):
    return _rounded(S.flux(T.frames(spark, sf)), 4, "flux")


@register("spectral_centroid", "SELECT series, round(sum(bin * m * m) / greatest(1.0::DOUBLE, sum(m * m)), 6) AS centroid FROM bins GROUP BY series", T.FRAMES_SQL, T.BINS_SQL)
def spectral_centroid(spark, sf):
    return _rounded(S.centroid(T.frames(spark, sf)), 6, "centroid")


@register(
    "band_share",
    "SELECT series, frame, " + ", ".join(f"round(CASE WHEN sum(m) > 0 THEN sum(CASE WHEN frame > 0 AND bin BETWEEN {a} AND {b} THEN greatest(0.0::DOUBLE, m - before) ELSE 0.0 END) / sum(m) ELSE 0.0 END, 6) AS b{i}" for i, (a, b) in enumerate(((0, 8), (8, 20), (20, 40), (40, 63)))) + " FROM long GROUP BY series, frame",
    T.FRAMES_SQL,
    T.BINS_SQL,
    BEFORE,
)
def band_share(spark, sf):
    return _rounded(S.band_share(T.frames(spark, sf)), 6, "b0", "b1", "b2", "b3")


@register("dft_power", "SELECT series, h, round((power(sum(x * cos(2 * pi() * h * k / 720)), 2) + power(sum(x * sin(2 * pi() * h * k / 720)), 2)) / 1e6, 4) AS power FROM signal CROSS JOIN (SELECT unnest(range(0, 32)) AS h) GROUP BY series, h", T.SIGNAL_SQL)
def dft_power(spark, sf):
    return S.dft_power(T.signal(spark, sf), 720, 32).withColumn("power", F.round(F.col("power") / 1e6, 4))


CHROMA = "chroma AS (SELECT series, (bin % 12)::INT AS tone, sum(m) AS v FROM bins GROUP BY ALL)"
_PROFILE = ", ".join(f"({root}, {'true' if mode else 'false'}, {(root + j) % 12}, {p}::DOUBLE)" for root in range(12) for mode, prof in enumerate((S.MAJOR, S.MINOR)) for j, p in enumerate(prof))
SCORES = f"scores AS (SELECT series, root, minor, corr(v, p) AS score FROM chroma JOIN (VALUES {_PROFILE}) t(root, minor, tone, p) USING (tone) GROUP BY series, root, minor)"
_MIXES = "CASE WHEN {a}minor = {b}minor THEN ({b}root - {a}root + 24) % 12 IN (0, 5, 7) ELSE (CASE WHEN {a}minor THEN {a}root - {b}root ELSE {b}root - {a}root END + 24) % 12 = 9 END"


def _chroma(spark, sf):
    return S.bins(T.frames(spark, sf)).groupBy("series", F.pmod("bin", F.lit(12)).alias("tone")).agg(F.sum("m").alias("v"))


@register("key_profile_corr", "SELECT series, root, minor, round(score, 6) AS score FROM scores", T.FRAMES_SQL, T.BINS_SQL, CHROMA, SCORES)
def key_profile_corr(spark, sf):
    return _rounded(S.key_scores(_chroma(spark, sf)), 6, "score")


@register(
    "key_estimate",
    "SELECT b.series, (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[b.root + 1] || CASE WHEN b.minor THEN ' minor' ELSE ' major' END AS key, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, b.score - max(s.score))), 6) AS confidence FROM (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY series ORDER BY score DESC, root, minor) = 1) b JOIN scores s ON s.series = b.series AND NOT ("
    + _MIXES.format(a="b.", b="s.")
    + ") GROUP BY b.series, b.root, b.minor, b.score",
    T.FRAMES_SQL,
    T.BINS_SQL,
    CHROMA,
    SCORES,
)
def key_estimate(spark, sf):
    return _rounded(S.keys(_chroma(spark, sf)), 6, "confidence")


_KEYS_SQL = "k AS (SELECT DISTINCT (p_partkey % 24)::INT AS id, (p_partkey % 12)::INT AS root, p_partkey % 24 >= 12 AS minor FROM part)"


@register("key_compat_pairs", "SELECT a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.id <= b.id AND " + _MIXES.format(a="a.", b="b."), _KEYS_SQL)
def key_compat_pairs(spark, sf):
    k = T.table(spark, sf, "part").select(F.pmod("p_partkey", F.lit(24)).cast("int").alias("id")).distinct()
    k = k.withColumn("root", F.pmod("id", F.lit(12))).withColumn("minor", F.col("id") >= 12)
    # The partners of a key are listed, and met by equality.
    steps = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).alias("m")) for s, m in ((0, False), (5, False), (7, False), (9, True))])
    partner = k.withColumn("_s", F.explode(steps)).select(
        F.col("id").alias("id_a"),
        F.when(~F.col("_s.m"), F.pmod(F.col("root") + F.col("_s.s"), F.lit(12))).otherwise(F.pmod(F.when(F.col("minor"), F.col("root") - 9).otherwise(F.col("root") + 9), F.lit(12))).alias("root"),
        (F.col("minor") != F.col("_s.m")).alias("minor"),
    )
    return partner.join(k.withColumnRenamed("id", "id_b"), ["root", "minor"]).where("id_a <= id_b").select("id_a", "id_b")


_LABELS = ("C major", "F# minor", "B♭ major", "e♭ minor", "G♯ Minor", "Cb major", "H major", "A  minor", "D", "B# major")


@register(
    "key_parse",
    "SELECT label, CASE WHEN len(m) > 0 THEN ((CASE upper(m[1]) WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 WHEN 'B' THEN 11 END + CASE m[2] WHEN '#' THEN 1 WHEN 'b' THEN -1 ELSE 0 END + 12) % 12)::INT END AS root, CASE WHEN len(m) > 0 THEN lower(m[3]) = 'minor' END AS minor, n FROM (SELECT label, n, CASE WHEN regexp_matches(t, '^([A-Ga-g])([#b]?)\\s+(?i:(major|minor))$') THEN [regexp_extract(t, '^([A-Ga-g])([#b]?)\\s+(?i:(major|minor))$', 1), regexp_extract(t, '^([A-Ga-g])([#b]?)\\s+(?i:(major|minor))$', 2), regexp_extract(t, '^([A-Ga-g])([#b]?)\\s+(?i:(major|minor))$', 3)] ELSE [] END AS m FROM (SELECT label, count(*) AS n, any_value(translate(trim(label), '♯♭', '#b')) AS t FROM (SELECT (["
    + ", ".join(f"'{x}'" for x in _LABELS)
    + "])[1 + p_partkey % 10] AS label FROM part) GROUP BY label))",
)
def key_parse(spark, sf):
    label = F.get(F.array(*map(F.lit, _LABELS)), F.pmod("p_partkey", F.lit(10)).cast("int"))
    found = T.table(spark, sf, "part").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    root, minor = S.parse_key(F.col("label"))
    return found.select("label", root.cast("int").alias("root"), minor.alias("minor"), "n")


@register(
    "midi_notes",
    "SELECT event_id, m AS midi, (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[(m % 12) + 1] || (m // 12 - 1) AS note, round(100 * (e - m), 4) AS cents FROM (SELECT event_id, 69 + 12 * log2((50 + value) / 440.0) AS e, floor(69 + 12 * log2((50 + value) / 440.0) + 0.5)::INT AS m FROM events)",
)
def midi_notes(spark, sf):
    found = S.midi(50 + F.col("value"))
    return T.table(spark, sf, "events").select("event_id", found["midi"].alias("midi"), found["note"].alias("note"), F.round(found["cents"], 4).alias("cents"))


@register("yin_difference", "SELECT a.series, b.k - a.k AS lag, round(sum(power(a.x - b.x, 2)) / count(*), 4) AS d FROM signal a JOIN signal b ON a.series = b.series AND b.k - a.k BETWEEN 0 AND 48 GROUP BY a.series, b.k - a.k", T.SIGNAL_SQL)
def yin_difference(spark, sf):
    return _rounded(S.yin_difference(T.signal(spark, sf), 720, 48), 4, "d")


@register(
    "lerp_lookup",
    "SELECT p.series, p.t, round(s.x + (least(greatest(p.t, 0.0), 719.0) - s.k) * (coalesce(s.nx, s.x) - s.x), 6) AS value FROM (SELECT series, t FROM (SELECT DISTINCT series FROM signal) CROSS JOIN (SELECT unnest(range(-8, 2900)) * 0.25::DOUBLE AS t)) p JOIN (SELECT *, lead(x) OVER (PARTITION BY series ORDER BY k) AS nx FROM signal) s ON s.series = p.series AND s.k = floor(least(greatest(p.t, 0.0), 719.0))::BIGINT",
    T.SIGNAL_SQL,
)
def lerp_lookup(spark, sf):
    signal = T.signal(spark, sf)
    probes = signal.select("series").distinct().withColumn("i", F.explode(F.sequence(F.lit(-8), F.lit(2899)))).select("series", (F.col("i") * 0.25).alias("t"))
    return _rounded(S.lerp(signal, probes), 6, "value")


@register(
    "peak_plateau",
    "SELECT series, avg(k) AS frame, max(x) AS x, count(*) AS n FROM (SELECT series, k, x, k - row_number() OVER (PARTITION BY series ORDER BY k) AS g FROM (SELECT *, max(x) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM signal) WHERE x > 100 AND x = m) GROUP BY series, g",
    T.SIGNAL_SQL,
)
def peak_plateau(spark, sf):
    return S.plateau_peaks(T.signal(spark, sf), 100.0)


@register(
    "chunk_stitch",
    "SELECT series, chunk, count(*) AS frames, min(frame) AS first_frame, max(frame) AS last_frame FROM (SELECT series, frame, min(chunk) AS chunk FROM (SELECT series, n, chunk, unnest(range(CASE WHEN chunk = 0 THEN 0 ELSE start + 6 END, least(n - 1, start + 63 - CASE WHEN start + 64 >= n THEN 0 ELSE 6 END) + 1)) AS frame FROM (SELECT series, n, chunk, CASE WHEN chunk = c - 1 AND n > 64 THEN n - 64 ELSE chunk * 52 END AS start FROM (SELECT *, unnest(range(0, c)) AS chunk FROM (SELECT series, n, greatest(1, ceil((n - 12) / 52.0))::BIGINT AS c FROM (SELECT o_orderkey AS series, floor(o_totalprice / 2000)::BIGINT + 1 AS n FROM orders)) )))  GROUP BY series, frame) GROUP BY series, chunk",
)
def chunk_stitch(spark, sf):
    sizes = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("series"), (F.floor(F.col("o_totalprice") / 2000) + 1).alias("n"))
    frames = S.stitch(S.chunks(sizes, 64, 6), 64, 6)
    return frames.groupBy("series", "chunk").agg(F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
