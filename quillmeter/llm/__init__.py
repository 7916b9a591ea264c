"""Training-data operators: de-duplication, counting, scoring, packing and formatting of text corpora."""
