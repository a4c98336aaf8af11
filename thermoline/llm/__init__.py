"""Training-data operators: one module an operator, and `queries` that registers them."""
