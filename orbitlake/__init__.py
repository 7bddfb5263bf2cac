"""orbitlake: element-set catalogs, orbit time series and interval analytics on Spark."""

__version__ = "0.1.0"
