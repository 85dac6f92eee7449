"""Conversation and session feature analytics on Spark."""
