"""Where operators keep finished steps: tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import threading
import time
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of ids up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000
#: Seconds that must lie between two times that the driver frees memory which finished steps have left.
FREE_EVERY = 5.0
#: Whether Spark deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows in one Arrow batch; texts are long, and a worker holds a few batches at a time.
ARROW_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once in an application; workers need not find it where the driver does."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemill_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = Path(tempfile.mkdtemp(prefix="tidemill-")).resolve()  # the driver serves it from here as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "tidemill.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(folder / "tidemill.zip"))
    sc._tidemill_shipped = True


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators rely on, and the package on all executors."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def sent_if_few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table of ids, to be broadcast if it is checked to have no more than `most` rows; beyond, joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Steps:
    """Tables of one operator's run; a lost executor costs no finished step."""

    #: Runs that have tables, in the order they began.
    opened: list[Steps] = []
    freed = 0.0

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.thread = threading.get_ident()
        self.tables: dict[int, tuple[DataFrame, str]] = {}
        if not Steps.opened:
            atexit.register(Steps.close_all)
        Steps.opened.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back. Shuffle files of what led to it go, as the same plan never runs again."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        schema, before = df.schema, self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        self.free()
        found = self.spark.read.schema(schema).parquet(path)
        self.tables[id(found)] = (found, path)
        return found

    def put_and_tell(self, df: DataFrame, name: str, **told) -> tuple[DataFrame, dict]:
        """put(), and aggregates of the rows that were written, found on the way."""
        seen = Observation()
        found = self.put(df.observe(seen, *[c.alias(n) for n, c in told.items()]), name)
        return found, seen.get

    def same(self, table: DataFrame, view: DataFrame) -> DataFrame:
        """The view, known as the table that it reads."""
        self.tables[id(view)] = (view, self.tables.pop(id(table))[1])
        return view

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this run that no plan still to be run reads."""
        for t in tables:
            if id(t) in self.tables:
                self._delete(self.tables.pop(id(t))[1])

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """Write the result and delete all other tables of this run."""
        found = self.put(df, name)
        self.drop(*[t for t, _ in self.tables.values() if t is not found])
        return found

    @classmethod
    def close_since(cls, before: list[Steps]) -> None:
        """Delete all tables of the runs that this thread began beside those in `before`; nothing may read them any more."""
        for s in [s for s in cls.opened if s not in before and s.thread == threading.get_ident()]:
            cls.opened.remove(s)
            s._delete(s.root)

    @classmethod
    def close_all(cls) -> None:
        """Delete what is left when the application ends."""
        with contextlib.suppress(Exception):  # the session may have ended before
            for s in cls.opened:
                s._delete(s.root)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def free(self) -> None:
        """The driver's two processes hand memory back that planning took; now and then only, as it takes a while."""
        if time.monotonic() - Steps.freed < FREE_EVERY:
            return
        gc.collect()
        jvm = self.spark.sparkContext._jvm
        jvm.System.gc()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        with contextlib.suppress(Py4JError):  # not every JVM has the command
            name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
            jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(name, "systemTrimNativeHeap", None, None)
        Steps.freed = time.monotonic()


def numbered(steps: Steps, docs: DataFrame) -> DataFrame:
    """(_n, _row): the rows of docs as structs, each with a number of its own; written, so that all reads agree on it."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return steps.put(docs.select(F.monotonically_increasing_id().alias("_n"), row.alias("_row")), "rows")
