"""Texts.java as functions on columns. The driver's JVM compiles it with Janino, which Spark brings along for its own
generated code, and hands executors the classes as a jar, so no machine needs a compiler or shared files for it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from importlib import resources

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASS = "stockweave.Texts"
CHANGES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("type", "field", "from_value", "to_value")]))
_loaders: dict[str, object] = {}


def _classes(spark: SparkSession):
    """The class loader with the compiled classes; executors of this application get them too."""
    sc = spark.sparkContext
    if sc.applicationId not in _loaders:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(resources.files(__package__).joinpath("Texts.java").read_text(encoding="utf-8"))
        folder = os.path.realpath(tempfile.mkdtemp())
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        jar = f"{folder}/texts.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(jar)
        _loaders[sc.applicationId] = compiler.getClassLoader()
    return _loaders[sc.applicationId]


def call(name: str, returns: T.DataType, *columns: Column) -> Column:
    """A function of Texts.java, in the active session."""
    spark = SparkSession.active()
    made = _classes(spark).loadClass(f"{CLASS}${name}").newInstance()
    function = f"stockweave_text_{name.lower()}"
    spark._jsparkSession.udf().register(function, made, spark._jsparkSession.parseDataType(returns.json()))
    return F.call_udf(function, *columns)
