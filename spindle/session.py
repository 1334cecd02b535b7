"""Sessions, and the package on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def get_session(app: str = "spindle", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; ``conf`` adds settings, dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Rows that are worth a task of their own, where each is the work of a file.
TASK_ROWS = 500


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table that is small on disk, dealt to all tasks: by its few row groups one or two would do all the work of them."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(max(1, min(tasks, rows.count() // TASK_ROWS)), key)


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application, unless their path has it already."""
    root = Path(__file__).resolve().parent.parent
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(p and Path(p).resolve() == root for p in places):
        return
    folder = tempfile.mkdtemp(prefix="spindle-")
    target = os.path.join(folder, "spindle_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.glob("spindle/**/*.py")):
            z.write(f, f.relative_to(root).as_posix())
        pipeline = root / "corpus_pipeline.py"
        if pipeline.exists():
            z.write(pipeline, pipeline.name)
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
