"""commitlens package."""
