"""Training-data operators: filters, de-duplication, packing, PII, token files."""
