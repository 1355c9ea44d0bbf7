"""Memory analytics on Spark: retrieval, session, lifecycle and corpus operators over DataFrames."""
