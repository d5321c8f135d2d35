"""Aggregators and the relational forms that rules compile to."""
