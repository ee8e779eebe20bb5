"""Makes the package importable in the Python workers of the running application."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext

_ROOT = Path(__file__).resolve().parent
_done: set[str] = set()


def ship_package() -> None:
    """Hand the package's sources to Spark, once per application.

    Arrow functions and broadcast blocks refer to it by name, and a worker started
    elsewhere would not find it.  Spark distributes the archive to all executors.
    """
    sc = SparkContext._active_spark_context
    if sc is None or sc.applicationId in _done:
        return
    archive = Path(tempfile.mkdtemp(prefix="mailvane-src-")) / "mailvane_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(_ROOT.rglob("*.py")):
            z.write(source, source.relative_to(_ROOT.parent))
    sc.addPyFile(str(archive))
    _done.add(sc.applicationId)
