"""Spike trains, behaviour and their statistics as Spark DataFrame operators."""
