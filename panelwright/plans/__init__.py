"""Panelwright: plans."""
