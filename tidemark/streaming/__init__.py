"""Bars and recursive filters over streams."""
