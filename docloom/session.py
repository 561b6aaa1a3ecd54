"""Session helper, and shipping this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "docloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the operators are tested with."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the workers, once a context, so that they can be
    imported there wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_docloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="docloom-ship-")) / "docloom_ship.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._docloom_shipped = True
