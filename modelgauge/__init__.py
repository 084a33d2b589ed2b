"""Quality and coverage analytics over SQL transformation projects, as Spark DataFrames."""
