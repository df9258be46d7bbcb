"""Column expressions: everything here stays inside one narrow stage."""
