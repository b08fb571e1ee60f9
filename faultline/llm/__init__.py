"""Training-data operators: packing, language ID, chat formatting, decontamination,
quality rules, line dedup, WARC, SimHash near-dedup, HTML extraction and PII."""
