"""Training-data operators: language, decontamination, PII, packing, counts, quality, near copies, chat, URLs, shards."""
