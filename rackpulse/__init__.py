"""rackpulse: data-centre fleet analytics as Spark DataFrame, SQL, ML and streaming jobs."""
