"""What a session needs before it runs code of this package on executors."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch, where the session has Spark's default: texts may be long, and a worker holds a batch whole.
BATCH_ROWS, _DEFAULT, _KEY = "2048", "10000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once for each application: their Python need not find the repository."""
    if spark.conf.get(_KEY, _DEFAULT) == _DEFAULT:
        spark.conf.set(_KEY, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root, held = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, Path(root.name) / path.relative_to(root))
        folder = tempfile.mkdtemp()  # the driver serves the file from there until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        name = os.path.join(folder, f"{root.name}.zip")
        Path(name).write_bytes(held.getvalue())
        spark.sparkContext.addPyFile(name)
        _shipped.add(app)
    return spark
