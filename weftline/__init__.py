"""weftline: a PySpark engine for web content, timed media and training corpora."""
