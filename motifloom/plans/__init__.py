"""Configuration, whole runs, outputs and the registered queries."""
