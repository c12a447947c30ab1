"""Column expressions. Built-in Spark functions only, so all of it stays in the JVM."""
