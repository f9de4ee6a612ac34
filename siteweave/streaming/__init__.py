"""Streams of sites through the same operators."""
