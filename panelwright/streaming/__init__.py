"""Panelwright: streaming."""
