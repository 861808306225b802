"""Entity features, model folds and prediction blending as Spark jobs."""
