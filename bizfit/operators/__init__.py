"""Table operators: standardisation, matching, annotation, scoring, search."""
