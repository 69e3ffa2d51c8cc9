"""Column expressions: packet flags, labels, event fields, kernels, bytes."""
