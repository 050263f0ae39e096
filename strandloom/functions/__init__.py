"""Column functions on sequences; everything stays inside the JVM."""
