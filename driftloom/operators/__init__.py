"""Dataflow operators: encoding, drift, sampling, shifts, metrics, policies."""
