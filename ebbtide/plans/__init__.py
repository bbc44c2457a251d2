"""Registered queries, their SQL twins and execution helpers."""
