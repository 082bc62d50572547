"""Column functions: normalisation, families, perturbations."""
