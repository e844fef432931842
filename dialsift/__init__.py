"""dialsift: contact-propensity analytics expressed as Spark DataFrame jobs.

Sub-packages
------------
sources     table readers: the ``attempts`` view and the pipe-delimited scan
functions   column-expression helpers (safe division, key-hashed uniforms, ...)
operators   cleaning, features, statistics, sampling, kNN, metrics, ranking
models      Spark ML model registry, training runner and random-search tuning
plans       composed prepare / learn / evaluate jobs and the query catalog
streaming   applying fitted feature + scaling plans to a streaming source
"""

__version__ = "0.1.0"
