"""Operators over memories: extract, store, retrieve, format, summarise, report, change, evaluate."""
