"""trailstone: spatial, trajectory and text-corpus analytics expressed as Spark DataFrame jobs."""
