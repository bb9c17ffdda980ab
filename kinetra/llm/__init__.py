"""Training-data operators: ten DataFrame-to-DataFrame operators over documents, vectors and pages."""
