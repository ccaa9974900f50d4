"""Column -> Column building blocks, all inside Spark's own expressions unless a docstring says otherwise."""
