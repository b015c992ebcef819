"""loomline: condensation of command output, logs and other line-oriented text on PySpark."""
