"""Column helpers.  Everything here stays inside JVM expressions."""
