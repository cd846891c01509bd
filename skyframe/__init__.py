"""Preparation, checking and evaluation of paired sky-image tiles as Spark DataFrame operators."""
