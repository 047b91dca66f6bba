"""Training-data operators: archives, token counts and files, language-model scores, deduplication, decontamination,
byte-pair encoding and quality rules. Nothing else in the library imports this subpackage."""
