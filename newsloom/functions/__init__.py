"""Column -> Column building blocks; all run inside the JVM except ``html_fields``."""
