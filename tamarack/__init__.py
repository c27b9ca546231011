"""Tamarack: text moderation and corpus analytics as Spark plans."""
