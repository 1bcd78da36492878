"""Mail statistics as Spark jobs: sources, dedupe, counters, repair, run status."""
