"""Decision pipelines: whole plans and removal gates built from the operators."""
