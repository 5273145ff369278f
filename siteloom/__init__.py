"""Company-identity analytics over web-page collections, written as Spark DataFrame jobs."""
