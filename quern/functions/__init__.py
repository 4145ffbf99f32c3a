"""Column functions: from Columns to Columns, all inside the JVM."""
