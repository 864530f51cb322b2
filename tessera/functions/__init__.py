"""
``Column`` built from JVM-side Spark functions, so they stay inside whole-stage
codegen or higher-order-function evaluation; no Python per row."""
