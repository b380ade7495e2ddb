"""Training-data operators: archives, personal data, fingerprints, toxicity, language-model scores,
decontamination, quality, licences, near-duplicates and packing."""
