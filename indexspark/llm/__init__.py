"""Operators for preparing training data: one module per operator, all working on whole tables and whole texts."""
