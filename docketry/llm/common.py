"""What several operators share: word rule, hold-out rule, shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, in Java and RE2 syntax.
SPACE = r"[\x20\x09-\x0D]+"

#: Temporary folders of sessions that run in one process.
_own: dict[str, str] = {}
#: Tables that each session has stored.
_made: dict[str, list[str]] = {}


def words(text: Column | str) -> Column:
    """Array of the words of a text; empty for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column | str) -> Column:
    """How many words a text has; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace("[", "[^", 1))), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, bound to a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free(taken: Iterable[str], *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores in front as make it unlike all of ``taken`` (cases don't count)."""
    used = {c.lower() for c in taken}

    def one(name: str) -> str:
        while name.lower() in used:
            name = f"_{name}"
        return name

    return tuple(map(one, names))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fifth of the documents that no model may learn from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from spark.checkpoint.dir.

    Where that isn't set, a session in one process gets a temporary folder; on a cluster it
    is an error, as no folder is known to be shared.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="docketry-shared-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so later stages don't run the plan again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def clean(spark: SparkSession) -> int:
    """Removes the tables that ``stored`` has made in this session, once what reads them is stored or read; their number.

    Checkpoints go by themselves where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


#: Rows and bytes of texts up to which a table is sent to every task.
SENT_ROWS, SENT_BYTES = 500_000, 64 << 20


def sent(few: DataFrame) -> DataFrame:
    """The rows, sent to every task of a join if they are counted to be few, else left to a shuffle."""
    size = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in few.schema if f.dataType.simpleString() == "string"), F.lit(8 * len(few.columns)))
    rows, held = few.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(few) if rows <= SENT_ROWS and held <= SENT_BYTES else few


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
