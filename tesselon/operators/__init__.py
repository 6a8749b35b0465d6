"""Relational operators on tiles, points and scores."""
