"""filterlab: approximate-membership filters and their analytics as ordinary Spark jobs."""
