"""Functions in Java, compiled from source by Janino, which Spark has for its own plans; no other compiler is needed.

For loops over single values that neither built-in expressions nor numpy do fast.  The classes go to the executors as a
jar that the session adds.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from importlib import resources

from pyspark.sql import SparkSession
from pyspark.sql.types import _parse_datatype_string

_known: set[tuple[str, str, str]] = set()


def function(spark: SparkSession, name: str, returns: str) -> str:
    """Name under which ``F.call_function`` finds class ``tesselon.<name>`` of ``<name>.java`` beside this file (a Java UDF interface)."""
    session, called = spark._jsparkSession, f"tesselon_{name.lower()}"
    key = (spark.sparkContext.applicationId, session.sessionUUID(), name)
    if key not in _known:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(resources.files(__package__).joinpath(f"{name}.java").read_text())
        jar = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tesselon-")), f"{name}.jar")
        classes = compiler.getBytecodes()
        with zipfile.ZipFile(jar, "w") as out:
            for c in classes:
                out.writestr(c.replace(".", "/") + ".class", bytes(classes[c]))
        session.sql(f"ADD JAR '{jar}'")
        made = compiler.getClassLoader().loadClass(f"tesselon.{name}").newInstance()
        session.udf().register(called, made, session.parseDataType(_parse_datatype_string(returns).json()))
        _known.add(key)
    return called
