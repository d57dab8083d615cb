"""Panelwright: functions."""
