"""Operators composed to plans, and the queries registered for the driver."""
