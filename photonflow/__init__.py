"""photonflow: point-table, image-series and event analytics as Spark jobs."""
