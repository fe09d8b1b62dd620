"""Recursive-descent recognisers with precedence-climbing expressions and panic-mode recovery, one for each language."""
