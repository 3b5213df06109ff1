"""trailmetrics: workflow-trace analytics written as Spark jobs."""
