"""Column functions: text, numbers, the arithmetic program language, scores and classifiers."""
