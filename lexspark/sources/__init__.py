"""Sources of lexspark."""
