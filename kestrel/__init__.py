"""kestrel: encounter analytics and corpus preparation as Spark jobs."""
