"""Training-data operators: decontamination, quality rules, deduplication,
licence scans, source mixing, language-model scoring, personal data and
token output.  Nothing else in the library imports this subpackage."""
