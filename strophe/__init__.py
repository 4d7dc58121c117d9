"""strophe: ordered time series, interval hierarchies and similarity graphs on PySpark."""
