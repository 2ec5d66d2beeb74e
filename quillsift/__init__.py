"""Mail triage and corpus analytics expressed as Spark DataFrames."""
