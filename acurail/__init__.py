"""acurail: acuity-decision analytics as Spark DataFrame transforms.

Every operator is a ``DataFrame -> DataFrame`` function built from
built-in Spark expressions, shared by batch jobs and Structured Streaming.
"""

__version__ = "0.1.0"
