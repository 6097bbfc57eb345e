"""Compositions: operators put together to reports, decks and verdicts."""
