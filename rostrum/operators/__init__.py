"""Part of rostrum."""
