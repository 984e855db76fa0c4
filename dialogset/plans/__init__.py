"""Composed jobs: dataset build (W10), scoring (K1), models (K2/K3), reports
(K4-K7), and the registry of queries exposed by ``__spark_entry__``."""
