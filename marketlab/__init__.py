"""Simulation and validation of systematic trading rules, and preparation of training corpora, on Spark."""
