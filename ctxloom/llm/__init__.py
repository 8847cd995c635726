"""Training-data operators: packing, secrets, tokens, decontamination, dedup, language and chat."""
