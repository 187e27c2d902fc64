"""parcelspark: city housing analytics as lazy Spark DataFrame operators.

functions/  column expressions          operators/  DataFrame -> DataFrame steps
sources/    readers                      sinks/      writers
plans/      the build and the registered queries
streaming/  incremental ingestion
"""

__version__ = "0.1.0"
