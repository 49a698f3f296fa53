"""Reports and reviewable action plans, built from the operators."""
