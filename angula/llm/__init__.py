"""Training-data operators: scans, scoring, dedup, decontamination and mixing."""
