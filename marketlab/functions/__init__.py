"""Part of marketlab."""
