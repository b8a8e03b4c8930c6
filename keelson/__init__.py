"""keelson: Spark-native data engine for model-operations workloads.

Every operator is a function ``DataFrame -> DataFrame`` (or a few frames in,
one out) built from DataFrame / Spark SQL expressions so Catalyst sees the
whole plan.  Nothing is collected to the driver except bounded control values
(a handful of quantile bounds, a boolean guard at a sink).
"""

__version__ = "0.1.0"
