"""A feed of questions.  The operators themselves are batch operators; this only hands them micro-batches."""
