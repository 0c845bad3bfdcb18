"""mergewright: record normalisation, entity resolution and coverage analytics on Spark DataFrames."""
