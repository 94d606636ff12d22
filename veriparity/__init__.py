"""Data-quality and fairness audits as Spark DataFrame plans."""
