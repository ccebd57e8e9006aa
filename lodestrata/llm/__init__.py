"""Operators for preparing text: format duplicates, personal information, token ids, leakage, subject areas."""
