"""Rule model, compiler and the built-in rules."""
