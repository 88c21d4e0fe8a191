"""Session helpers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()
#: Bytes that Spark hands a Python worker at once, unless the session says otherwise, and that a worker makes Python values of at once.
BATCH, PIECE = 4 << 20, 1 << 20


def get_session(app: str = "spindrift", **conf: str) -> SparkSession:
    """A session with the settings the library is tested with; an existing session is kept."""
    b = SparkSession.builder.appName(app)
    for k, v in ({"spark.sql.session.timeZone": "UTC"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where the session has none, a temporary
    folder on one machine (tests) and an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spindrift-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def over_batches(fn: Callable, kind: str) -> Callable[[Column | str], Column]:
    """A function of one value as a column function that works on Arrow batches. Values that are null give null."""

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(StructType.fromDDL(f"v {kind}")["v"].dataType)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.concat_arrays([pa.array([None if v is None else fn(v) for v in part.to_pylist()], arrow) for part in pieces(b)])

    return F.arrow_udf(run, kind)


def pieces(values: pa.Array, size: int = PIECE) -> Iterator[pa.Array]:
    """An array in slices of some size bytes, one value at least; one slice if it is empty."""
    step = max(1, len(values) * size // max(1, values.nbytes))
    for i in range(0, max(1, len(values)), step):
        yield values.slice(i, step)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python workers can
    import it wherever it is installed on the driver. Batches for them are of BATCH bytes, unless the session has a bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "1") == "1":  # not set: the default must be a size
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root, buffer = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    fd, name = tempfile.mkstemp(prefix="spindrift-", suffix=".zip")
    with os.fdopen(fd, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(name)
