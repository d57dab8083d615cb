"""Panelwright: operators."""
