"""Part of bandweave."""
