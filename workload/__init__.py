"""Registered queries over the test tables, each with its SQL twin where SQL can say it."""

from workload import (cleaning, columns, encoding, flagship, iterative, learning, neighbours, ontology, profiles,
                      sources, splits_metrics)

FAMILIES = [flagship, columns, profiles, cleaning, encoding, splits_metrics, ontology, neighbours, sources, learning,
            iterative]
