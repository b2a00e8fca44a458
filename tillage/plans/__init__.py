"""Multi-job plans built from the operators: model comparison, quantile boosting,
permutation importance, per-group models, classification, scoring, text generation."""
