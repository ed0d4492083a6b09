"""Operators for training data: duplicates, leakage, residue, quality, mixing and personal information in large text collections."""
