"""Column functions: text, hashes, grading, arrays. All but the stated UDFs stay in the JVM."""
