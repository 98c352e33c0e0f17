"""Column helpers: row-local folds, text slices, match offsets, value checks."""
