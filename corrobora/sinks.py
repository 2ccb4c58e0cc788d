"""One ordered document out of many tasks' lines, on the store that driver and executors share.

Tasks write the lines of their range as parts; the prefix sums of the parts' lengths are where each belongs. Where the
store is mounted, tasks then copy the parts to their places in one file, all at once; elsewhere the store joins the
parts if it can (concat), or they are copied one after another in small pieces. No line comes to the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.tables import fresh

#: Bytes copied at a time.
PIECE = 1 << 20


def _copy(target: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                with open(r.part, "rb") as source, open(target, "r+b") as out:
                    out.seek(r.base)
                    while piece := source.read(PIECE):
                        out.write(piece)
            yield batch[["base"]]

    return run


def write_document(lines: DataFrame, path: str, *order: Column, text: str = "text") -> int:
    """Writes the ``text`` of all rows, each with a line feed behind it, in order; returns the length in bytes.

    The document takes the place of an older one when it is whole. Rows that tie come in some order, null texts are
    empty lines, no rows make an empty document.
    """
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    fs = at(path).getFileSystem(conf)
    scratch = f"{path}.{uuid.uuid4().hex}"
    names = fresh([text], *(f"__k{i}" for i in range(len(order))))
    keyed = lines.select(F.coalesce(F.col(text), F.lit("")).alias(text), *(c.alias(n) for c, n in zip(order, names, strict=True)))
    keyed.repartitionByRange(*names).sortWithinPartitions(*names).select(text).write.option("lineSep", "\n").text(f"{scratch}.parts")
    # Names and lengths only; the parts' names have their order.
    parts = sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(at(f"{scratch}.parts")) if s.getPath().getName().startswith("part-"))
    lengths = [n for _, n in parts]
    bases = [0, *accumulate(lengths)]
    made = at(f"{scratch}.new")
    if fs.getUri().getScheme() == "file":
        target = urlparse(made.toString()).path
        with open(target, "wb") as out:
            out.truncate(bases[-1])
        rows = [(urlparse(p).path, b) for (p, n), b in zip(parts, bases, strict=False) if n]
        if rows:
            spark.createDataFrame(rows, "part string, base long").repartition(len(rows), "base").mapInPandas(_copy(target), "base long").count()
    else:
        fs.create(made, True).close()
        _join(spark, fs, made, [p for p, n in parts if n])
    if fs.getFileStatus(made).getLen() != bases[-1]:
        raise OSError(f"{path}: the parts have {bases[-1]} bytes, the document has {fs.getFileStatus(made).getLen()}")
    if fs.getUri().getScheme() == "file":
        os.replace(urlparse(made.toString()).path, urlparse(at(path).toString()).path)
    else:
        fs.delete(at(path), False)
        fs.rename(made, at(path))
    fs.delete(at(f"{scratch}.parts"), True)
    return bases[-1]


def _join(spark, fs, made, parts: list[str]) -> None:
    """The parts behind one another, by the store itself or through a small buffer."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in parts]
    array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(paths))
    for i, p in enumerate(paths):
        array[i] = p
    try:
        if paths:
            fs.concat(made, array)
    except Exception:  # noqa: BLE001  most stores cannot
        out = fs.create(made, True)
        for p in paths:
            stream = fs.open(p)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, PIECE, False)
            stream.close()
        out.close()
