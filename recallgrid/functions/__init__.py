"""Column builders; Arrow UDFs only where no built-in expression exists."""
