"""Column functions: text, numbers, dates and arrays. All stay inside the JVM."""
