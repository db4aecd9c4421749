"""foliomark: document structuring on Spark.

Text in, clean Markdown out, for a corpus table instead of one file at a time.

``functions``  Column -> Column building blocks (no shuffle, JVM only)
``operators``  DataFrame -> DataFrame operators over docs / pages / lines / chunks
``sources``    file scans, identity, extraction hook, sinks
``plans``      options and the end-to-end conversion plan
``streaming``  the same conversion for files that keep arriving
``workload``   derived views, registered queries and their SQL counterparts
"""

from foliomark.plans.convert import ConvertOptions, convert, convert_directory

__all__ = ["ConvertOptions", "convert", "convert_directory"]
