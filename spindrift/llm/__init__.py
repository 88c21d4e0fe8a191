"""Training-data operators: secrets, deduplication, decontamination, URL and
quality filters, toxicity, byte-level BPE and PII. Self-contained: nothing
outside this subpackage imports it."""
