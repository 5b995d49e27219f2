"""Kernels are batch plans; there are no streaming operators to offer here."""
