"""Feature matrices, spatial folds, model family, metrics, registry."""
