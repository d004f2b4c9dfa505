"""Column expressions: Column in, Column out, no actions, usable on batch and streaming frames."""
