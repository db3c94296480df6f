"""Helpers that the corpus operators share: word splitting, per-row Arrow maps, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an Arrow batch that are turned into Python objects at a time.
ROWS_AT_ONCE = 256


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() splits at just these six characters."""
    return encoded(text).split()


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALNUM = bytes(_LOWER[c] if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def lowered_words(text: str | None) -> list[bytes]:
    """plain_words after lower-casing A-Z only."""
    return encoded(text).translate(_LOWER).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    return encoded(text).translate(_ALNUM).split()


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for up to ``most`` words."""

    def __init__(self, most: int = 150_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hashes (mod 2**64) of all windows of ``width`` items, mixed so that all bits are usable."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base = np.uint64(base | 1)
    with np.errstate(over="ignore"):
        # doubling: windows of width 2**k from windows of half that width
        power, have, size = hashes.astype(np.uint64), 0, 1
        scale, offset = base, 0
        bits = width
        while bits:
            if bits & 1:
                part = power[offset : offset + n]
                out = out * scale + part if have else part.copy()
                offset, have = offset + size, have + size
            bits >>= 1
            if bits:
                power = power[: len(power) - size] * scale + power[size:]
                scale, size = scale * scale, size * 2
        return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def with_outputs(df: DataFrame, text: str, make: Callable[[], Callable], fields: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``df`` and those of ``fields`` (DDL), computed from column ``text`` in Arrow batches.

    make() runs once per task and gives a function of a list of texts (None for null) that returns a list of
    columns in the order of ``fields``. A column of ``df`` whose name (in any case) is an output's gives way to it.
    A text column that stays is sent to the workers once, not a second time to be read.
    """
    new = T._parse_datatype_string(fields)
    gone = {f.name.lower() for f in new} | {d.lower() for d in drop}
    kept = [c for c in df.columns if c.lower() not in gone]
    sent = [F.col(quoted(c)) for c in kept]
    if text in kept and df.schema[text].dataType == T.StringType():
        at_text = kept.index(text)
    else:
        at_text = len(kept)
        sent.append(F.col(quoted(text)).cast("string").alias("__text__"))
    source = df.select(*sent)
    schema = T.StructType([df.schema[c] for c in kept] + list(new.fields))
    width, arrow_new = len(kept), to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                columns = work(batch.column(at_text).to_pylist())
                made = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow_new, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=[*batch.schema.names[:width], *arrow_new.names])

    return source.mapInArrow(run, schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir where the cluster sets it, else one of our own; only a local master has that."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("tallyforge.scratch.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            found = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("tallyforge.scratch.dir", found)
    return found


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and a lost executor costs no recomputation."""
    path = f"{checkpoint_dir(df.sparkSession)}/tallyforge-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table made by as_table()."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("tallyforge-"):
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
