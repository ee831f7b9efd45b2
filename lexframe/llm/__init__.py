"""Training-data operators: scans, classifiers, deduplication, decontamination and mixing."""
