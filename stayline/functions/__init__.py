"""Column expressions: typing, text, time and list helpers.  All run inside the JVM."""
