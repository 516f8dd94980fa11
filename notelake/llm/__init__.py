"""Training-data operators: filters, extraction, duplicates, decontamination, mixing and token output. Nothing else in the library imports this subpackage."""
