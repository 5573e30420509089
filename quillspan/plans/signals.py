"""Queries on signals, features and models, with SQL where it gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import dsp, morphology, tcn
from quillspan.operators import ml, signal
from quillspan.plans import views
from quillspan.plans.views import SAMPLES_SQL
from quillspan.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SIZE = 64


def query(sql: str | None = None):
    """Register a function under its name with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _arrays(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("recording_id"), F.col("embedding").cast("array<double>").alias("x"), "label")


@query("""WITH w AS (SELECT vec_id AS recording_id, embedding, unnest(range(3 * 2)) AS window_id FROM embeddings) SELECT recording_id, window_id, round(list_sum(embedding[window_id * 8 + 1 : window_id * 8 + 16]::DOUBLE[]), 6) AS total, round(embedding[window_id * 8 + 1]::DOUBLE, 6) AS first FROM w""")
def sliding_windows(spark, d) -> DataFrame:
    w = _arrays(spark, d).select("recording_id", F.posexplode(signal.windows_of("x", 16, 8, 2)).alias("window_id", "w"))
    return w.select("recording_id", F.col("window_id").cast("long").alias("window_id"), F.round(signal.total("w"), 6).alias("total"), F.round(F.col("w")[0], 6).alias("first"))


DFT_SQL = f"""{SAMPLES_SQL}, k AS (SELECT unnest(range(33)) AS k), dft AS (SELECT recording_id, k, pow(sum(x * cos(2 * pi() * k * n / 64)), 2) + pow(sum(x * sin(2 * pi() * k * n / 64)), 2) AS p FROM samples, k GROUP BY ALL)"""


def _power(spark, d) -> DataFrame:
    return signal.power_spectrum(_arrays(spark, d), "recording_id", "x")


@query(f"WITH {DFT_SQL} SELECT recording_id, k, round(p, 4) AS power FROM dft")
def dft_power(spark, d) -> DataFrame:
    return _power(spark, d).select("recording_id", F.posexplode("p").alias("k", "p")).select("recording_id", F.col("k").cast("long").alias("k"), F.round("p", 4).alias("power"))


def _bank_sql(bank) -> str:
    return ", ".join(f"({b}, {k}, {float(w)!r}::DOUBLE)" for b, row in enumerate(bank) for k, w in enumerate(row) if w > 0)


BANK = dsp.mel_bank(2000.0, SIZE, 8)


@query(f"WITH {DFT_SQL}, bank(band, k, w) AS (VALUES {_bank_sql(BANK)}) SELECT recording_id, band, round(sum(w * p), 6) AS energy FROM dft JOIN bank USING (k) GROUP BY ALL")
def mel_energy(spark, d) -> DataFrame:
    e = _power(spark, d).select("recording_id", F.posexplode(signal.bank_energy("p", BANK)).alias("band", "energy"))
    return e.select("recording_id", "band", F.round("energy", 6).alias("energy"))


@query(f"WITH {DFT_SQL}, l AS (SELECT recording_id, k, 10 * log10(greatest(p, 1e-10::DOUBLE)) AS v FROM dft) SELECT recording_id, k, round(greatest(v - max(v) OVER (PARTITION BY recording_id), -80), 4) AS db FROM l")
def amplitude_db(spark, d) -> DataFrame:
    return _power(spark, d).select("recording_id", F.posexplode(signal.decibels("p")).alias("k", "v")).select("recording_id", F.col("k").cast("long").alias("k"), F.round("v", 4).alias("db"))


@query(f"""WITH {DFT_SQL}, t AS (SELECT recording_id, k * 31.25::DOUBLE AS f, p, sum(p) OVER (PARTITION BY recording_id) AS t, sum(p) OVER (PARTITION BY recording_id ORDER BY k) AS c FROM dft), m AS (SELECT *, sum(f * p) OVER (PARTITION BY recording_id) / t AS m FROM t)
SELECT recording_id, round(any_value(m), 4) AS centroid, round(sqrt(sum(pow(f - m, 2) * p) / any_value(t)), 4) AS bandwidth, round(exp(avg(ln(p + 1e-10::DOUBLE))) / avg(p + 1e-10::DOUBLE), 4) AS flatness, round(-sum((p / t + 1e-10::DOUBLE) * log2(p / t + 1e-10::DOUBLE)), 4) AS entropy,
round(min(f) FILTER (c >= 0.85::DOUBLE * t), 4) AS rolloff FROM m GROUP BY recording_id""")
def spectral_shape(spark, d) -> DataFrame:
    out = signal.spectral_shape(_power(spark, d), "p", 2000.0, SIZE)
    return out.select("recording_id", *(F.round(c, 4).alias(c) for c in ("centroid", "bandwidth", "flatness", "entropy", "rolloff")))


@query(f"""WITH {SAMPLES_SQL} SELECT recording_id, n, round((x - avg(x) OVER (PARTITION BY recording_id)) / (stddev_pop(x) OVER (PARTITION BY recording_id) + 1e-10::DOUBLE), 5) AS by_sample, round((x - avg(x) OVER (PARTITION BY n)) / (stddev_pop(x) OVER (PARTITION BY n) + 1e-10::DOUBLE), 5) AS by_time,
round((x - avg(x) OVER ()) / (stddev_pop(x) OVER () + 1e-10::DOUBLE), 5) AS by_batch, round((x - avg(x) OVER (PARTITION BY recording_id, n // 16)) / (stddev_pop(x) OVER (PARTITION BY recording_id, n // 16) + 1e-10::DOUBLE), 5) AS by_channel, round((x - avg(x) OVER (PARTITION BY n % 16)) / (stddev_pop(x) OVER (PARTITION BY n % 16) + 1e-10::DOUBLE), 5) AS by_frequency FROM samples""")
def znorm_axis(spark, d) -> DataFrame:
    """Scores along five axes, the samples read as images of 4 channels by 16 frequencies."""
    s = views.samples(spark, d).withColumns({"channel": F.floor(F.col("n") / 16), "frequency": F.col("n") % 16})
    axes = {"by_sample": ["recording_id"], "by_time": ["n"], "by_batch": [], "by_channel": ["recording_id", "channel"], "by_frequency": ["frequency"]}
    for name, axis in axes.items():
        s = signal.z_scores(s, axis, name=name)
    return s.select("recording_id", "n", *(F.round(c, 5).alias(c) for c in axes))


NEAR = "OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
MORPH_SQL = f"{SAMPLES_SQL}, m AS (SELECT *, max(x) {NEAR} AS dil, min(x) {NEAR} AS ero FROM samples), o AS (SELECT *, max(ero) {NEAR} AS opn, min(dil) {NEAR} AS cls FROM m)"


@query(f"""WITH {MORPH_SQL} SELECT recording_id, n, round(dil, 6) AS dilated, round(ero, 6) AS eroded, round(opn, 6) AS opened, round(cls, 6) AS closed, round(dil - ero, 6) AS gradient, round(x - ero, 6) AS inner_gradient, round(dil - x, 6) AS outer_gradient,
round(CASE WHEN dil - x < x - ero THEN dil WHEN dil - x > x - ero THEN ero ELSE x END, 6) AS toggled FROM o""")
def flat_morphology(spark, d) -> DataFrame:
    """Dilation, erosion, opening, closing, the gradients and the toggle mapping along time."""
    keys = ["recording_id"]
    s = views.samples(spark, d)
    s = signal.opened(s.withColumns({"dilated": signal.dilated(s, keys, "n", 2), "eroded": signal.eroded(s, keys, "n", 2)}), keys, "n", 2)
    hi, lo, x = F.col("dilated"), F.col("eroded"), F.col("x")
    r = lambda c: F.round(c, 6)
    return s.select("recording_id", "n", r("dilated").alias("dilated"), r("eroded").alias("eroded"), r("opened").alias("opened"), r("closed").alias("closed"), r(hi - lo).alias("gradient"), r(x - lo).alias("inner_gradient"), r(hi - x).alias("outer_gradient"), r(F.when(hi - x < x - lo, hi).when(hi - x > x - lo, lo).otherwise(x)).alias("toggled"))


@query(f"WITH {SAMPLES_SQL} SELECT recording_id, n // 4 AS tile, round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(max(x) - min(x), 6) AS gradient, round(0.5 * max(x) + 0.5 * avg(x), 6) + 0 AS mixed, round(0.5 * max(x) + 0.5 * min(x), 6) + 0 AS maxmin FROM samples GROUP BY ALL")
def pooling(spark, d) -> DataFrame:
    p = signal.pooled(views.samples(spark, d), ["recording_id"], "n", 4)
    return p.select("recording_id", "tile", *((F.round(c, 6) + 0.0).alias(c) for c in ("lo", "hi", "gradient", "mixed", "maxmin")))


@query(f"""WITH {SAMPLES_SQL}, q AS (SELECT recording_id, quantile_cont(x, 0.75) AS q FROM samples GROUP BY 1), e AS (SELECT recording_id, n // 8 AS f, sum(x * x) AS e FROM samples GROUP BY ALL), t AS (SELECT *, sum(e) OVER (PARTITION BY recording_id) AS t FROM e),
h AS (SELECT recording_id, -sum((e / t + 1e-10::DOUBLE) * log2(e / t + 1e-10::DOUBLE)) AS h, stddev_pop(sqrt(e / 8)) AS r FROM t GROUP BY 1)
SELECT recording_id, count(*) FILTER (x > q) AS n_above, round(any_value(h), 5) AS energy_entropy, round(any_value(r), 6) AS rms_std FROM samples JOIN q USING (recording_id) JOIN h USING (recording_id) GROUP BY 1""")
def energy_shape(spark, d) -> DataFrame:
    """Samples above the upper quartile, entropy of energy over time, deviation of the level."""
    s = views.samples(spark, d)
    e = s.groupBy("recording_id", F.floor(F.col("n") / 8).alias("f")).agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    share = F.col("e") / F.sum("e").over(Window.partitionBy("recording_id")) + F.lit(1e-10)
    h = e.withColumn("s", share).groupBy("recording_id").agg((-F.sum(F.col("s") * F.log2("s"))).alias("h"), F.stddev_pop(F.sqrt(F.col("e") / 8)).alias("r"))
    q = s.groupBy("recording_id").agg(F.percentile("x", F.lit(0.75)).alias("q"))
    return s.join(q, "recording_id").groupBy("recording_id").agg(F.count_if(F.col("x") > F.col("q")).alias("n_above")).join(h, "recording_id").select("recording_id", "n_above", F.round("h", 5).alias("energy_entropy"), F.round("r", 6).alias("rms_std"))


@query("""WITH w AS (SELECT vec_id AS recording_id, label, embedding, unnest(range(6)) AS window_id FROM embeddings),
t AS (SELECT *, list_transform(embedding[window_id * 8 + 1 : window_id * 8 + 16]::DOUBLE[], lambda v: v) AS x, embedding[window_id * 8 + 9] > 0 AS hit FROM w)
SELECT recording_id, window_id, round(list_sum(x) - list_sum(x[7:10]), 6) AS total, hit::INT AS label, CASE WHEN hit THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM t""")
def training_windows(spark, d) -> DataFrame:
    """Windows with the class of their middle sample (its sign), class weights, and four masked samples."""
    y = F.transform("x", lambda v: F.when(v > 0, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))
    out = signal.training_windows(_arrays(spark, d).withColumn("y", y), "recording_id", "x", "y", 16, 8, 2, mask=2, class_weights=[0.5, 2.0])
    return out.select("recording_id", "window_id", F.round(signal.total("x"), 6).alias("total"), F.col("y")[1].cast("int").alias("label"), F.col("w").alias("weight"))


# ---- kernels by Arrow batches: no SQL --------------------------------------------------------

def _kernel(spark, d, f) -> DataFrame:
    out = signal.kernel(_arrays(spark, d), "recording_id", "x", f)
    return out.select("recording_id", F.transform("values", lambda v: F.round(v, 6)).alias("values"))


@query()
def mfcc(spark, d) -> DataFrame:
    """Means and deviations of 13 cepstra and their slopes."""
    return _kernel(spark, d, lambda x: dsp.mfcc_statistics(x, 2000.0, bands=12, n_fft=32, hop=8))


@query()
def resampled(spark, d) -> DataFrame:
    return _kernel(spark, d, lambda x: dsp.resample(x, 2000, 1500))


@query()
def band_passed(spark, d) -> DataFrame:
    return _kernel(spark, d, lambda x: dsp.band_pass(x, 100.0, 400.0, 2000.0))


@query()
def pitch(spark, d) -> DataFrame:
    return _kernel(spark, d, lambda x: dsp.yin(x, 2000.0, 80.0, 900.0, 64, 32))


@query()
def spectral_statistics(spark, d) -> DataFrame:
    return _kernel(spark, d, lambda x: list(dsp.spectral_statistics(x, 2000.0, 32, 8).values()))


@query()
def morphology_2d(spark, d) -> DataFrame:
    """Profiles of a 16 x 4 image: openings, top hats, reconstructions and pooled values."""

    def profile(x):
        image = x.reshape(16, 4)
        made = [morphology.opening(image, morphology.disk(3)), morphology.top_hat(image, morphology.flat(3)), morphology.h_maxima(image, 0.1), morphology.leveling(image, morphology.opening(image, morphology.flat(3)))]
        return [m.mean() for m in made] + morphology.pool(image, 4, "mixed").ravel().tolist()

    return _kernel(spark, d, profile)


@query()
def tcn_forward(spark, d) -> DataFrame:
    """Mean class probabilities of a small temporal network over each signal."""
    net = tcn.make(1, 8, 3)
    return _kernel(spark, d, lambda x: tcn.forward(net, x[:, None]).mean(axis=0))


# ---- features and models ---------------------------------------------------------------------

@query("SELECT vec_id, " + ", ".join(f"round((embedding[{i + 1}]::DOUBLE - avg(embedding[{i + 1}]::DOUBLE) OVER ()) / stddev_pop(embedding[{i + 1}]::DOUBLE) OVER (), 5) AS x{i}" for i in range(SIZE)) + " FROM embeddings")
def standard_scale(spark, d) -> DataFrame:
    """All SIZE components, x0 and so on."""
    names = [f"x{i}" for i in range(SIZE)]
    f = table(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)))
    return ml.scaled(f, names).select("vec_id", *(F.round(c, 5).alias(c) for c in names))


@query("""WITH g AS (SELECT DISTINCT vec_id % 20 AS g FROM embeddings), r AS (SELECT g, row_number() OVER (ORDER BY md5(g::VARCHAR)) AS r FROM g) SELECT vec_id, CASE WHEN r <= 4 THEN 'test' ELSE 'train' END AS split FROM embeddings JOIN r ON g = vec_id % 20""")
def group_split(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 20).alias("g"))
    return ml.group_split(rows, "g", 0.2).select("vec_id", "split")


@query("""SELECT vec_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR)) <= floor(count(*) OVER (PARTITION BY label) * 0.25) THEN 'test' ELSE 'train' END AS split FROM embeddings""")
def stratified_split(spark, d) -> DataFrame:
    return ml.stratified_split(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.25).select("vec_id", "split")


@query("""WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), p AS (SELECT user_id, row_number() OVER (ORDER BY n DESC, user_id) - 1 AS p FROM s) SELECT event_id, (CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END)::INT AS fold FROM events JOIN p USING (user_id)""")
def group_kfold(spark, d) -> DataFrame:
    return ml.group_folds(table(spark, d, "events").select("event_id", "user_id"), "user_id", 5).select("event_id", "fold")


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), n AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS dist FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, neighbour) AS place FROM n) SELECT query, neighbour, round(dist, 5) AS distance, place FROM r WHERE place <= 5""")
def knn_graph(spark, d) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20, in blocks of queries."""
    rows = table(spark, d, "embeddings")
    out = ml.nearest_neighbours(rows, rows.where("vec_id % 20 = 0"), 5)
    return out.select("query", "neighbour", F.round("distance", 5).alias("distance"), "place")


@query()
def kmeans(spark, d) -> DataFrame:
    rows = ml.as_vectors(table(spark, d, "embeddings"), "embedding")
    return ml.clustered(rows, 24).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def pca_embed(spark, d) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = ml.as_vectors(table(spark, d, "embeddings"), "embedding")
    return ml.embedded(rows).select("vec_id", F.transform(vector_to_array("embedding_k"), lambda v: F.round(v, 4)).alias("components"))


@query()
def cv_summary(spark, d) -> DataFrame:
    """Cross-validated accuracy and macro F1 of the three models over five group folds, and which is best."""
    rows = ml.as_vectors(table(spark, d, "embeddings"), "embedding").withColumn("g", F.col("vec_id") % 20)
    return ml.cross_validated(ml.group_folds(rows, "g", 5), 5)
