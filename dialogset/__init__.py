"""dialogset: build and evaluate dialogue classification datasets with Spark.

Every operator is a ``DataFrame -> DataFrame`` function (use it with
``df.transform``) or a ``Column -> Column`` expression builder.
"""

__version__ = "0.1.0"
