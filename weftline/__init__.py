"""weftline: a visual-ETL workflow engine and data-processing library on PySpark."""

__version__ = "0.1.0"
