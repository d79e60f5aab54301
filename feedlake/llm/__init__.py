"""Training-data operators: sharding, mixing, archives, chat formatting,
personal data, secrets, near-duplicates, toxicity, decontamination and
quality rules. Nothing else in the library imports this subpackage."""
