"""Column functions: text, dates, hashing, probabilities, ranges."""
