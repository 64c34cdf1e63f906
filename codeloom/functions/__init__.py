"""Column expressions; all stay inside the JVM unless said otherwise."""
