"""Column functions: text extraction and normalisation. All of them are built-in expressions."""
