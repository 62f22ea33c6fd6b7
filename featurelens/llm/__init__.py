"""Training-data operators: each module holds one operator with its general interface."""
