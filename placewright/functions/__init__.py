"""Column -> Column functions. Built-ins only, except where a docstring says why not."""
