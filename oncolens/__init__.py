"""Clinical cohorts and biomarker status tables as PySpark DataFrame operators."""
