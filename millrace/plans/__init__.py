"""Relational building blocks shared by the operators: counting, ordering, hashing, lookups, kNN."""
