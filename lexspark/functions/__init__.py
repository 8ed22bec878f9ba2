"""Functions of lexspark."""
