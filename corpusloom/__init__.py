"""Corpusloom: document-corpus analytics planned by Spark."""
