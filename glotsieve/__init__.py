"""Glotsieve: language identification for very large text tables on Spark."""
