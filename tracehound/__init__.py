"""tracehound: log forensics as Spark DataFrame operators."""
