"""Column functions: text, dates and arrays. All run inside the JVM."""
