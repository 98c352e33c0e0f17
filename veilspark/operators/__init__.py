"""Column and DataFrame operators: admission, detection, propagation, merge, redaction."""
