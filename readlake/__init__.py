"""Reading-corpus analytics as ordinary Spark DataFrame functions, SQL functions and streaming jobs."""
