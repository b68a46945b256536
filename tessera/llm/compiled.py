"""Functions in Java for loops over single ids and over words of sketches, which neither SQL nor numpy has; Spark's own compiler, Janino, makes them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Source, class and result of each function.
FUNCTIONS = {
    "tessera_encode_ids": ("TokenCoder", "Encode", "binary"),
    "tessera_decode_ids": ("TokenCoder", "Decode", "array<struct<within: long, ids: binary>>"),
    "tessera_words": ("Sketches", "Words", "binary"),
    "tessera_apart": ("Sketches", "Apart", "int"),
    "tessera_equal": ("Sketches", "Equal", "int"),
}
#: Compiled classes by the application whose executors have them, and the source.
_loaders: dict[tuple[str, str], object] = {}


def _loader(spark: SparkSession, source: str):
    """The classes of a source beside this file, sent to every executor once for an application."""
    app = spark.sparkContext.applicationId
    if (app, source) not in _loaders:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(Path(__file__).with_name(f"{source}.java").read_text("utf-8"))
        jar = f"{tempfile.mkdtemp(prefix='tessera-')}/tessera-{source}.jar"
        with zipfile.ZipFile(jar, "w") as out:
            for name, code in dict(compiler.getBytecodes()).items():
                out.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.sc().addJar(jar)
        for old in [k for k in _loaders if k[0] != app]:
            del _loaders[old]
        _loaders[app, source] = compiler.getClassLoader()
    return _loaders[app, source]


def call(spark: SparkSession, name: str, *columns: str | Column) -> Column:
    source, kind, result = FUNCTIONS[name]
    made = _loader(spark, source).loadClass(f"tessera.{source}${kind}").newInstance()
    spark._jsparkSession.udf().register(name, made, spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(result))
    return F.call_function(name, *[F.col(c) if isinstance(c, str) else c for c in columns])
