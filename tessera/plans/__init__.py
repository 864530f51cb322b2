"""Plans: fixture frames over the driver tables, the evaluation job, and the
query registry used by ``__spark_entry__``."""
