"""graphloom: attributed-graph analytics and corpus processing as Spark jobs."""
