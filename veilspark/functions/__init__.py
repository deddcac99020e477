"""Column builders: patterns, validators, scores, span algebra."""
