"""Column builders over arrays of numbers; everything here stays inside the JVM."""
