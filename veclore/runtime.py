"""Session defaults, and the two ways this library cuts a plan: a written table, or a size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "veclore", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the queries expect; anything the cluster already sets wins over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where that is unset and all runs on one machine a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-veclore-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path for a table of this application, in the shared folder."""
    return f"{shared_folder(spark)}/veclore/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once as parquet to the shared folder and read back: the lineage ends there, a lost executor
    recomputes nothing, and the optimizer knows the table's true size. ``discard`` removes what an application wrote."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Remove the tables this application wrote to the shared folder. Frames that read them are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/veclore/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a broadcast at most, as Spark's rows hold them.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting rows and bytes: beyond either bound the frame is returned as it is and the join
    shuffles."""
    wide = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    sizes = [F.coalesce(F.octet_length(c if df.schema[c].dataType.typeName() in ("string", "binary") else F.to_json(F.struct(c))), F.lit(0)) for c in wide]
    each = sum(sizes, F.lit(16 + 8 * len(df.columns)))
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("rows"), F.sum(each).alias("bytes")).first()
    return F.broadcast(df) if seen["rows"] <= max_rows and (seen["bytes"] or 0) <= max_bytes else df
