"""Column-expression helpers. Every helper returns a ``Column`` built from native Spark functions."""
