"""Shared plan shapes: ordered computations, stacked columns, one-pass profiles."""
