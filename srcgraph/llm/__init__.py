"""Training-data operators: secrets, repeated passages, personal data, tokens, archives,
fingerprints, repetition, language-model scores, mixing and similarity joins.

Nothing else in the library imports this subpackage.
"""
