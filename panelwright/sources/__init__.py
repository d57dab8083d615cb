"""Panelwright: sources."""
