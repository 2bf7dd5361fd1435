"""Slatewright: point-in-time analysis of personalised feeds as Spark plans."""
