"""Tessera: a Spark-first engine for cataloguing, searching and preparing large collections."""
