"""Spark jobs that turn the parsed pages of many reports into short documents."""
