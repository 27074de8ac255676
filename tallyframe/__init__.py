"""Tallyframe: invoice-extraction dataflows and data-quality operators as PySpark plans."""
