"""Session helpers: one place for the settings every query relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "quillspan", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the input tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch: what a Python worker holds of its input at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once per context, so that they need no shared path.

    Also keeps the session's Arrow batches small, so that long texts do not pile up in a worker.
    """
    context = spark.sparkContext
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    if not getattr(context, "_quillspan_shipped", False):
        import tempfile
        import zipfile
        from pathlib import Path

        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="quillspan-ship-")) / "quillspan.zip"
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, Path("quillspan") / path.relative_to(root))
        context.addPyFile(str(target))
        context._quillspan_shipped = True
    return spark


def shipped(queries: dict) -> dict:
    """The same queries, each of which ships the package before it runs."""
    return {name: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for name, f in queries.items()}
