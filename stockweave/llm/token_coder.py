"""TokenCoder.java as functions on columns. The driver's JVM compiles it with Janino, which Spark brings along for its
own generated code, and hands executors the classes as a jar, so no machine needs a compiler or shared files for it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from importlib import resources

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

CLASS = "stockweave.TokenCoder"
_loaders: dict[str, object] = {}


def _classes(spark: SparkSession):
    """The class loader with the compiled classes; executors of this application get them too."""
    sc = spark.sparkContext
    if sc.applicationId not in _loaders:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(resources.files(__package__).joinpath("TokenCoder.java").read_text(encoding="utf-8"))
        folder = os.path.realpath(tempfile.mkdtemp())
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        jar = f"{folder}/token-coder.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(jar)
        _loaders[sc.applicationId] = compiler.getClassLoader()
    return _loaders[sc.applicationId]


def _call(spark: SparkSession, name: str, *columns: Column | str) -> Column:
    made = _classes(spark).loadClass(f"{CLASS}${name}").newInstance()
    function = f"stockweave_token_{name.lower()}"
    spark._jsparkSession.udf().register(function, made, spark._jsparkSession.parseDataType(BinaryType().json()))
    return F.call_udf(function, *columns)


def written(spark: SparkSession, ids: Column | str, counts: Column | str) -> Column:
    """The file of ids and the documents' token counts, little-endian 32-bit numbers both; token_store.write_file in the JVM."""
    return _call(spark, "Write", ids, counts)


def read(spark: SparkSession, file: Column | str) -> Column:
    """The documents' token counts and then the ids of a file, as above; token_store.read_file in the JVM."""
    return _call(spark, "Read", file)


def sums(spark: SparkSession, file: Column | str) -> Column:
    """The documents' token counts and then the CRC-32 of each one's ids, as above, of the ids read from a file."""
    return _call(spark, "Sums", file)
