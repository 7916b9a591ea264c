"""Analytics of coding-agent activity as Spark jobs."""
