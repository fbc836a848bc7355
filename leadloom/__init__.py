"""Lead discovery, enrichment and market-coverage analytics as Spark jobs."""
