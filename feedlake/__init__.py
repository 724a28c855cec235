"""feedlake: blog, feed and page-snapshot analytics as Spark jobs."""
