"""Plans of lexspark."""
