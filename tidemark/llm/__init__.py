"""Training-data operators: near-duplicate search, language, scoring, formatting, mixing."""
